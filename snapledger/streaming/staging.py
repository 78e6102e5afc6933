"""Staging of a scan in durable chunks: what is hashed stays hashed, whatever ends the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(rows: DataFrame, size: int, folder: str, key: str = "relative_path") -> Iterator[tuple[int, int, DataFrame]]:
    """Parts of rows of about ``size`` each, by a hash of the key: number, how many there are, rows. The rows are written to ``folder`` once, a directory for each part, so a part costs its own rows."""
    total = rows.count()
    if not total:
        return
    n = -(-total // size)
    if n == 1:
        yield 0, 1, rows
        return
    rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(n))).repartition("_part").write.partitionBy("_part").parquet(folder)
    for k in [r[0] for r in rows.sparkSession.read.parquet(folder).select("_part").distinct().orderBy("_part").collect()]:
        yield k, n, rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/_part={k}")


def run(rows: DataFrame, size: int, folder: str, commit: Callable[[int, DataFrame], None], stop: Callable[[], bool]) -> bool:
    """Commit chunk after chunk; false if ``stop`` said so before the end. It's asked before every chunk and after the last."""
    for k, _, part in chunks(rows, size, folder):
        if stop():
            return False
        commit(k, part)
    return not stop()
