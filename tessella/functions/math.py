"""Scalar helpers shared by the analytics operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null (never 0) where the whole is 0 or null."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percentile(value: str, p: float) -> Column:
    """Nearest-rank percentile, rounded to three decimals; null over no values."""
    return F.round(F.expr(f"percentile_disc({p}) within group (order by {value})"), 3)


def distribution(value: str) -> list[Column]:
    """n, p50, p95 and p99 of a numeric column."""
    return [F.count(value).alias("n"), percentile(value, 0.5).alias("p50"), percentile(value, 0.95).alias("p95"), percentile(value, 0.99).alias("p99")]


def clamp(x: Column) -> Column:
    """x cut to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def duration_hours(text: str) -> int:
    """`7d` or `24h` in hours, from one hour to ten years."""
    unit = {"d": 24, "h": 1}.get(text[-1:])
    if unit is None or not text[:-1].isdigit() or not 1 <= int(text[:-1]) * unit <= 3650 * 24:
        raise ValueError(f"not a duration: {text!r}")
    return int(text[:-1]) * unit
