"""Sizes and ages for reading, as columns and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the report's format.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")
AGES = ((90, 1, "s", 0), (5_400, 60, "m", 0), (172_800, 3_600, "h", 1), (None, 86_400, "d", 1))


def _rounded(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def human(size: Column) -> Column:
    """Bytes with a binary unit; one decimal above bytes."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        text = F.concat(_rounded(size / F.lit(float(1024**k)), 1), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == UNITS[-1] else out.when(size < 1024 ** (k + 1), text)
    return out


def ago(then_ns: Column, now_ns: Column) -> Column:
    """Age of a moment; the future counts as now."""
    seconds = F.greatest(now_ns - then_ns, F.lit(0)) / F.lit(1e9)
    out = None
    for below, by, unit, digits in AGES:
        text = F.concat(_rounded(seconds / F.lit(float(by)), digits), F.lit(unit))
        out = F.when(seconds < below, text) if out is None else out.when(seconds < below, text) if below else out.otherwise(text)
    return out


def human_text(size: int) -> str:
    k = 0
    while size >= 1024 ** (k + 1) and k < len(UNITS) - 1:
        k += 1
    return f"{size / 1024**k:.1f} {UNITS[k]}" if k else f"{size} B"


def ago_text(then_ns: int, now_ns: int) -> str:
    seconds = max(0, now_ns - then_ns) / 1e9
    below, by, unit, digits = next(a for a in AGES if a[0] is None or seconds < a[0])
    return f"{seconds / by:.{digits}f}{unit}"
