"""The difference between a staged scan and the baseline: one full outer join classifies every path.

Known paths that the scan lacks are looked up among the unreadable paths: in place while those are few, by count, and by a join
of their ancestors otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions.paths import ancestors_or_self
from . import shield

#: Unreadable paths up to which they travel with the plan.
FEW = 1_000
COMPARED = ("size_bytes", "mtime_ns", "mime_type", "content_hash")
CONTENT = ("parent_path", "name", "extension", "size_bytes", "mtime_ns", "created_ns", "mime_type", "mime_source", "hash_algorithm", "content_hash", "hash_status")


def mask() -> Column:
    """Bits of the fields that differ. The type alone may be null on either side."""
    bit = lambda differs, value: F.when(differs, F.lit(value)).otherwise(F.lit(0))
    return (
        bit(F.col("old.size_bytes") != F.col("new.size_bytes"), D.SIZE_BIT)
        + bit(F.col("old.mtime_ns") != F.col("new.mtime_ns"), D.MTIME_BIT)
        + bit(~F.col("old.mime_type").eqNullSafe(F.col("new.mime_type")), D.MIME_BIT)
        + bit(F.col("old.content_hash") != F.col("new.content_hash"), D.HASH_BIT)
    ).cast("long")


def classified(baseline: DataFrame, staged: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Every path of either side once: ``relative_path``, structs ``old`` and ``new`` (null where absent), ``class``, ``field_mask``.

    Both sides have unique paths. Only paths that the scan lacks are looked up among the errors' paths.
    """
    pack = lambda df, name: df.select("relative_path", F.struct(*[F.col(c) for c in df.columns if c != "relative_path"]).alias(name))
    both = pack(baseline, "old").join(pack(staged, "new"), "relative_path", "full_outer")
    if errors is not None:
        bad = shield.unreadable(errors)
        few = bad.limit(FEW + 1).collect()
        absent = F.col("new").isNull() & (F.col("old.presence") != D.DELETED)
        if len(few) <= FEW:
            above = F.exists(ancestors_or_self(F.col("relative_path")), lambda a: a.isin([bytes(r[0]) for r in few]))
            both = both.withColumn("_held", F.when(absent, above) if few else F.lit(False))
        else:
            held = shield.shielded(both.filter(absent).select("relative_path"), errors).withColumn("_held", F.lit(True))
            both = both.join(held, "relative_path", "left")
    else:
        both = both.withColumn("_held", F.lit(None).cast("boolean"))
    here, known, dead = F.col("new").isNotNull(), F.col("old").isNotNull(), F.col("old.presence") == D.DELETED
    both = both.withColumn("field_mask", F.when(here & known & ~dead, mask()))
    kind = (
        F.when(here & (~known | dead), D.ADDED)
        .when(here & (F.col("field_mask") != 0), D.UPDATED)
        .when(here, D.UNCHANGED)
        .when(dead, D.TOMBSTONE)
        .when(F.col("_held"), D.HELD)
        .otherwise(D.REMOVED)
    )
    both = both.withColumn("class", kind).drop("_held")
    bits = F.when(F.col("class") == D.ADDED, D.ALL_BITS).when(F.col("class") == D.REMOVED, D.PRESENCE_BIT).otherwise(F.coalesce("field_mask", F.lit(0)))
    return both.withColumn("field_mask", bits.cast("long"))


def change_log(rows: DataFrame) -> DataFrame:
    """Change rows of classified rows. Added ones over a tombstone have its old values; deleted ones have no new values."""
    pairs = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in COMPARED for side in ("old", "new")]
    return rows.filter(F.col("class").isin(D.ADDED, D.UPDATED, D.REMOVED)).select("relative_path", F.col("class").alias("change_kind"), "field_mask", *pairs)


def next_files(rows: DataFrame, scan_id: int) -> DataFrame:
    """The state after the scan. Ids of new paths are null; unchanged rows keep the scan they come from unless they were unreadable."""
    new_wins = F.col("class").isin(D.ADDED, D.UPDATED, D.UNCHANGED)
    written = F.col("class").isin(D.ADDED, D.UPDATED) | ((F.col("class") == D.UNCHANGED) & (F.col("old.presence") == D.UNREADABLE))
    content = [F.when(written & F.lit(c != "hash_algorithm") | F.col("old").isNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in CONTENT if c in rows.select("new.*").columns]
    return rows.select(
        F.col("old.file_id").alias("file_id"),
        "relative_path",
        *content,
        F.when(new_wins, D.PRESENT).when(F.col("class") == D.HELD, D.UNREADABLE).otherwise(D.DELETED).alias("presence"),
        F.when(written, F.lit(scan_id)).otherwise(F.col("old.metadata_from_scan_id")).cast("long").alias("metadata_from_scan_id"),
        F.when(F.col("class") == D.REMOVED, F.lit(scan_id)).when(F.col("class") == D.TOMBSTONE, F.col("old.deleted_in_scan_id")).cast("long").alias("deleted_in_scan_id"),
    )


def numbered(files: DataFrame, last_id: int) -> DataFrame:
    """files with ids for rows that have none, from ``last_id`` + 1. New rows are numbered within 256 buckets of a hash of their path, in parallel."""
    fresh = files.filter(F.col("file_id").isNull()).withColumn("_bucket", F.substring(F.md5("relative_path"), 1, 2))
    sizes = fresh.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("relative_path"))
    fresh = fresh.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket").withColumn("file_id", F.lit(last_id) + F.col("_offset") + F.col("_rank"))
    return files.filter(F.col("file_id").isNotNull()).unionByName(fresh.select(*files.columns))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts of classified rows: staged files and bytes, each kind of change, unchanged, present, held as unreadable."""
    n = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    here = F.col("new").isNotNull()
    counts = rows.agg(
        F.count_if(here).alias("staged_files"),
        F.coalesce(F.sum("new.size_bytes"), F.lit(0)).cast("long").alias("staged_bytes"),
        n(D.ADDED).alias("added_count"),
        n(D.UPDATED).alias("updated_count"),
        n(D.REMOVED).alias("deleted_count"),
        n(D.ADDED, D.UPDATED, D.UNCHANGED).alias("present_count"),
        n(D.HELD).alias("unreadable_count"),
    )
    return counts.withColumn("unchanged_count", F.greatest(F.lit(0), F.col("staged_files") - F.col("added_count") - F.col("updated_count")).cast("long"))
