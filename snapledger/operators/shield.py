"""Which known paths lie at or below a path that could not be read: their absence proves nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import UNREADABLE_CODES
from ..functions.paths import SLASH, ancestors_or_self


def unreadable(errors: DataFrame) -> DataFrame:
    """Distinct, non-empty paths of errors that leave contents unknown."""
    return errors.filter(F.col("error_code").isin(*UNREADABLE_CODES) & (F.octet_length("relative_path") > 0)).select("relative_path").distinct()


def base_unread(errors: DataFrame) -> DataFrame:
    """One row if any error, of whatever code, is about the base itself, the empty path."""
    return errors.filter(F.octet_length("relative_path") == 0).limit(1)


def shielded(paths: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of paths at or below an unreadable path: each path looks up its own ancestors, an equi-join whatever the number of errors."""
    keyed = paths.select("relative_path").distinct().select("relative_path", F.explode(ancestors_or_self(F.col("relative_path"))).alias("_above"))
    found = keyed.join(unreadable(errors).withColumnRenamed("relative_path", "_above"), "_above", "left_semi").select("relative_path").distinct()
    return paths.join(found, "relative_path", "left_semi")


def not_shielded(paths: DataFrame, errors: DataFrame) -> DataFrame:
    return paths.join(shielded(paths.select("relative_path").distinct(), errors), "relative_path", "left_anti")


def shielded_directly(paths: DataFrame, errors: DataFrame) -> DataFrame:
    """The same by comparing every path with every unreadable path; for few errors, and to check the other form."""
    bad = unreadable(errors).select(F.col("relative_path").alias("_e"))
    p, e = F.col("relative_path"), F.col("_e")
    below = (F.substring(p, F.lit(1), F.octet_length(e)) == e) & (F.substring(p, F.octet_length(e) + 1, F.lit(1)) == F.lit(SLASH))
    return paths.join(bad, (p == e) | below, "left_semi")


def unreadable_count(errors: DataFrame) -> DataFrame:
    return errors.filter(F.col("error_code").isin(*UNREADABLE_CODES)).agg(F.count_distinct("relative_path").alias("n"))
