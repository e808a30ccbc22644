"""Hashes that do not depend on partitioning, so that re-run tasks give equal rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

TWO_32 = float(2**32)


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def keyed_hash32(key: Column | str, *tags) -> Column:
    parts = [col(key).cast("string")] + [t if isinstance(t, Column) else F.lit(str(t)) for t in tags]
    return hash32(F.concat(*parts))


def gaussian(key: Column | str, *tags, sigma: float = 1.0) -> Column:
    """Normal draw made from two hashed uniforms (Box-Muller), fixed per key and tags."""
    u1 = (keyed_hash32(key, *tags, "u") + F.lit(1)) / F.lit(TWO_32 + 1)
    u2 = (keyed_hash32(key, *tags, "v") + F.lit(1)) / F.lit(TWO_32 + 1)
    return F.lit(float(sigma)) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
