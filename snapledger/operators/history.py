"""Retention of change history and of tombstones, by the k-th newest complete scan of each base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domain as D


def cutoffs(scans: DataFrame, bases: DataFrame, keep: int) -> DataFrame:
    """(base_id, cutoff) for every base: what is older than the cutoff may go; null where fewer than ``keep`` scans are complete or ``keep`` is 0. Never newer than the baseline."""
    rank = F.row_number().over(W.partitionBy("base_id").orderBy(F.desc("scan_id")))
    kth = scans.filter(F.col("status") == D.COMPLETE).select("base_id", "scan_id", rank.alias("_k")).filter(F.col("_k") == keep).select("base_id", F.col("scan_id").alias("_kth"))
    least = F.when(F.col("_kth").isNotNull(), F.least("_kth", "last_complete_scan_id"))
    return bases.join(kth, "base_id", "left").select("base_id", least.alias("cutoff"))


def old_changes(changes: DataFrame, limits: DataFrame) -> DataFrame:
    return changes.join(limits, "base_id").filter(F.col("scan_id") < F.col("cutoff")).drop("cutoff")


def old_tombstones(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Deleted rows, never unreadable ones."""
    dead = files.filter(F.col("presence") == D.DELETED)
    return dead.join(limits, "base_id").filter(F.col("deleted_in_scan_id") < F.col("cutoff")).drop("cutoff")


def preview(changes: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """For each base its cutoff and how many change rows and tombstones are prunable."""
    n = lambda df, name: df.groupBy("base_id").agg(F.count(F.lit(1)).alias(name))
    out = limits.join(n(old_changes(changes, limits), "changes"), "base_id", "left").join(n(old_tombstones(files, limits), "files"), "base_id", "left")
    return out.select("base_id", "cutoff", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("files", F.lit(0)).alias("files"))


def _kept(rows: DataFrame, limits: DataFrame, old) -> DataFrame:
    joined = rows.join(limits, "base_id", "left")
    return joined.filter(~F.coalesce(old, F.lit(False))).select(*rows.columns)


def kept_changes(changes: DataFrame, limits: DataFrame) -> DataFrame:
    return _kept(changes, limits, F.col("scan_id") < F.col("cutoff"))


def kept_files(files: DataFrame, limits: DataFrame) -> DataFrame:
    return _kept(files, limits, (F.col("presence") == D.DELETED) & (F.col("deleted_in_scan_id") < F.col("cutoff")))
