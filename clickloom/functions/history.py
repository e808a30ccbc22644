"""Expressions over the numeric history columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clip, col, flag, ratio, upper_bins

# Bin edges, clip bounds and thresholds.
RATE_EDGES = (0.05, 0.1, 0.2, 1.0)
RATE_CLIP = 10.0
RATE_HIGH = 0.2
RATE_VERY_HIGH = 1.0
DEPTH_EDGES = (-1000.0, -500.0, -200.0)
DEPTH_CLIP = -5000.0
DEPTH_NEAR_ZERO = -200.0


def rate_clipped(h: Column | str) -> Column:
    return clip(h, upper=RATE_CLIP)


def rate_log(h: Column | str) -> Column:
    return F.log1p(F.coalesce(col(h), F.lit(0.0)))


def rate_bin(h: Column | str) -> Column:
    return upper_bins(h, RATE_EDGES)


def above(h: Column | str, threshold: float, null_flag: int | None = None) -> Column:
    out = flag(col(h) > F.lit(threshold))
    return out if null_flag is None else F.coalesce(out, F.lit(null_flag).cast("tinyint"))


def depth_clipped(h: Column | str) -> Column:
    return clip(h, lower=DEPTH_CLIP)


def depth_bin(h: Column | str) -> Column:
    return upper_bins(h, DEPTH_EDGES)


def delta(first: Column | str, third: Column | str) -> Column:
    return col(first) - col(third)


def shift_ratio(first: Column | str, third: Column | str) -> Column:
    return ratio(first, third)


def trend(first: Column | str, third: Column | str) -> Column:
    """1 rising, -1 falling, 0 level or unknown."""
    change = delta(first, third)
    return F.when(change > 0, F.lit(1)).when(change < 0, F.lit(-1)).otherwise(F.lit(0))
