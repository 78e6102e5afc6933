"""Which observed files need hashing: those that neither the stage nor the baseline knows with the same size and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D

FROM_STAGE, FROM_BASELINE, TO_HASH = "stage", "baseline", "hash"


def decided(observed: DataFrame, staged: DataFrame, baseline: DataFrame) -> DataFrame:
    """observed with ``decision`` and the ``content_hash``, ``hash_algorithm``, ``hash_status`` to reuse (null for those to hash).

    The stage goes before the baseline, of which only present rows with complete hashes count.
    """
    pick = lambda df, name: df.select("relative_path", F.struct("size_bytes", "mtime_ns", "content_hash", "hash_algorithm", "hash_status").alias(name))
    good = baseline.filter((F.col("presence") == D.PRESENT) & (F.col("hash_status") == D.HASH_COMPLETE))
    rows = observed.join(pick(staged, "_s"), "relative_path", "left").join(pick(good, "_b"), "relative_path", "left")
    same = lambda side: (F.col(f"{side}.size_bytes") == F.col("size_bytes")) & (F.col(f"{side}.mtime_ns") == F.col("mtime_ns"))
    decision = F.when(same("_s"), FROM_STAGE).when(same("_b"), FROM_BASELINE).otherwise(TO_HASH)
    rows = rows.withColumn("decision", decision)
    for c in ("content_hash", "hash_algorithm", "hash_status"):
        rows = rows.withColumn(c, F.when(F.col("decision") == FROM_STAGE, F.col(f"_s.{c}")).when(F.col("decision") == FROM_BASELINE, F.col(f"_b.{c}")))
    return rows.drop("_s", "_b")


def latest_staged(stage: DataFrame, order: str) -> DataFrame:
    """One row a path of staged rows: that of the latest chunk."""
    return stage.groupBy("relative_path").agg(F.max_by(F.struct(*[c for c in stage.columns if c not in ("relative_path", order)]), order).alias("_r")).select("relative_path", "_r.*")


def still_seen(staged: DataFrame, seen: DataFrame) -> DataFrame:
    """Staged rows whose path this attempt has seen too."""
    return staged.join(seen.select("relative_path").distinct(), "relative_path", "left_semi")
