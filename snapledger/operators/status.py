"""Read-only questions about bases and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions.paths import absolute


def resumable(scans: DataFrame) -> DataFrame:
    """Each base's newest scan that isn't finished."""
    newest = scans.filter(F.col("status").isin(*D.RESUMABLE)).groupBy("base_id").agg(F.max(F.struct("scan_id", "status", "started_at_ns")).alias("_s"))
    return newest.select("base_id", "_s.*")


def baselines(bases: DataFrame, scans: DataFrame) -> DataFrame:
    """Every base with the scan that it was last completed by, if any."""
    done = scans.select(F.col("scan_id").alias("last_complete_scan_id"), F.col("scan_id").alias("baseline_scan_id"), "finished_at_ns", "present_count")
    return bases.join(done, "last_complete_scan_id", "left").select("base_id", "base_path", "baseline_scan_id", "finished_at_ns", "present_count")


def policy_differences(bases: DataFrame, policy: dict[str, bool]) -> DataFrame:
    """Bases whose inclusion policy isn't the given one, and the names of what differs."""
    parts = [F.when(F.col(name) != F.lit(policy[name]), F.lit(name)) for name in D.POLICY]
    return bases.select("base_id", F.concat_ws(", ", *parts).alias("differs")).filter("differs <> ''")


def current_files(files: DataFrame, bases: DataFrame) -> DataFrame:
    """Present files with their absolute path and hash as text. Bases are few; adaptive execution broadcasts them when they are."""
    rows = files.filter(F.col("presence") == D.PRESENT).join(bases.select("base_id", "base_path"), "base_id")
    keep = ("parent_path", "name", "extension", "size_bytes", "mtime_ns", "created_ns", "mime_type", "mime_source", "hash_algorithm", "hash_status")
    return rows.select(
        "file_id", "base_path", absolute(F.col("base_path"), F.col("relative_path")).alias("absolute_path"), "relative_path", *keep, F.hex("content_hash").alias("content_hash_hex"), "metadata_from_scan_id"
    )
