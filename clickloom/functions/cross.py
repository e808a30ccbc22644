"""Interactions and crosses of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash32
from .temporal import hour_block
from .values import col

HASH_BUCKETS = 100_000


def rate_by_length(h: Column | str, n: Column | str) -> Column:
    return col(h) * F.log1p(col(n))


def rate_by_length_log(h: Column | str, n: Column | str) -> Column:
    return F.log1p(rate_by_length(h, n) + F.lit(1.0))


def joined_text(*parts: Column | str) -> Column:
    """Parts as text joined by ``_``; null if any part is null."""
    cols = [col(p).cast("string") for p in parts]
    pieces = [cols[0]]
    for c in cols[1:]:
        pieces += [F.lit("_"), c]
    return F.concat(*pieces)


def day_hour(day: Column | str, hour: Column | str) -> Column:
    """Day and four-hour block, both as text of doubles, e.g. ``5.0_3.0``."""
    return joined_text(col(day).cast("double"), hour_block(hour))


def hash_cross(left: Column | str, right: Column | str, buckets: int = HASH_BUCKETS, engine: str = "md5") -> Column:
    """Bucket of the joined text. ``md5`` can be recomputed by any SQL engine;
    ``xxhash64`` is the cheaper choice when only Spark reads the result."""
    text = joined_text(left, right)
    if engine == "md5":
        return (hash32(text) % F.lit(buckets)).cast("int")
    return F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int"))
