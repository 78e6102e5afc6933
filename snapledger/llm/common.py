"""What the operators share: reading tables, text rules, tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side of a join is broadcast; a count is taken before.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none and runs in this process, as in tests, one of our own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = spark.conf.get("spark.snapledger.shared.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="snapledger-")
        spark.conf.set("spark.snapledger.shared.dir", made)
    return made


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here and lost executors lose nothing.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/snapledger/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """df with each row as one struct ``_row``, so that no name of its columns can clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of packed rows."""
    return [df["_row"].getField(c).alias(c) for c in columns]


def columns(df: DataFrame) -> dict:
    """The columns of a small table as numpy arrays, without a Python object for each value."""
    got = df.toArrow()
    out = {c: got[c].to_numpy() for c in got.column_names}
    del got
    released()
    return out


def released() -> None:
    """Give memory that Arrow's pool holds, but no table does, back to the system: what a step took in the driver doesn't add to what the next one takes."""
    pa.default_memory_pool().release_unused()


def least_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows, never more, those with the least hashes of a column; all if there are fewer. Tasks send few rows that aren't among them."""
    total = df.count()
    part = min(1.0, (n + 4 * n**0.5) / max(1, total))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return (df if part == 1 else df.filter(h < F.lit(int(part * (1 << 40))))).orderBy(h, key).limit(n)


def frequent(counts: DataFrame, count: str, n: int) -> DataFrame:
    """Rows with the largest counts, as many as fit in n without splitting rows of equal counts. Nothing is sorted but the levels of counts, at most a million."""
    level = F.least(F.col(count), F.lit(1_000_000))
    least, room = 1 << 62, n
    for r in counts.groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_level")).toLocalIterator():
        room -= r["_n"]
        if room < 0:
            break
        least = r["_level"]
    return counts.filter(F.col(count) >= least)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner", parts: int = 1_000) -> DataFrame:
    """Join rows, ``total`` of them, with a large table that has one row for each key and says in ``count`` how many rows have it.

    Keys of more than one in ``parts`` rows, fewer than parts, are broadcast, so their rows stay where they are; the others are joined by shuffling.
    """
    hot = F.col(count) > F.lit(max(1, total // parts))
    some = keyed.filter(hot)
    cold = rows.join(F.broadcast(some.select(key)), key, "left_anti").join(keyed.filter(~hot), key, how)
    return rows.join(F.broadcast(some), key).unionByName(cold)


def join_small(rows: DataFrame, small: DataFrame, key: str, how: str = "left", bound: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join rows, whose keys may be hot, with a table that has one row for each key.

    Counted first: a table of at most ``bound`` rows is broadcast. A larger one is replicated ``salts`` times
    and the rows are dealt over the salts, so that a key that holds a third of all rows is spread; ``salts`` of 1 is for keys that are nearly unique.
    """
    if small.count() <= bound:
        return rows.join(F.broadcast(small), key, how)
    if salts == 1:
        return rows.join(small, key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t]), F.lit(salts)).cast("int"))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str, max_bytes: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join wide rows, inner or left, with a table whose keys few of them have.

    Counted first: a table of at most ``bound`` rows is broadcast. Of a larger one a Bloom filter of at most ``max_bytes`` is, and rows whose key it
    doesn't hold stay out of the shuffle.
    """
    if few.count() <= bound:
        return rows.join(F.broadcast(few), key, how)
    filter_ = bloom.build(few, key, max_bytes)
    marked = rows.withColumn("_might", bloom.might_contain(filter_, rows.sparkSession, F.xxhash64(key)))
    met = marked.filter("_might").drop("_might").join(few, key, how)
    return met if how == "inner" else met.unionByName(marked.filter("not _might").drop("_might"), allowMissingColumns=True)
