"""Expressions over the comma-separated event sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clip, col, flag, upper_bins

# Bin edges, clip bound, frequent items and truncation length.
LENGTH_EDGES = (100, 200, 500, 1000)
LENGTH_CLIP = 5000
FREQUENT_ITEMS = ("74", "101", "479", "57", "408")
MAX_ITEMS = 100


def items(seq: Column | str = "seq") -> Column:
    return F.split(col(seq), ",")


def length(seq: Column | str = "seq", null_length: int | None = None) -> Column:
    """Comma count plus one. Counted on the text, so no array is built."""
    seq = col(seq)
    n = F.length(seq) - F.length(F.replace(seq, F.lit(","), F.lit(""))) + F.lit(1)
    return n if null_length is None else F.coalesce(n, F.lit(null_length))


def length_clipped(n: Column | str, upper: int = LENGTH_CLIP) -> Column:
    return clip(n, upper=upper)


def length_log(n: Column | str) -> Column:
    return F.log1p(col(n))


def length_bin(n: Column | str, edges: tuple[int, ...] = LENGTH_EDGES) -> Column:
    return upper_bins(n, edges)


def very_short(n: Column | str, limit: int = LENGTH_EDGES[0]) -> Column:
    return flag(col(n) <= F.lit(limit))


def diversity_proxy(seq: Column | str, n: Column | str) -> Column:
    """Characters per expected character: length(seq) / (3 * items + 1)."""
    return F.length(col(seq)) / (col(n) * F.lit(3) + F.lit(1))


def has_item(seq: Column | str, item: str, boundary: bool = False) -> Column:
    """Does the sequence hold the item? By default only inner items count;
    ``boundary=True`` also finds it in first and last place."""
    seq = col(seq)
    text = F.concat(F.lit(","), seq, F.lit(",")) if boundary else seq
    return flag(F.contains(text, F.lit(f",{item},")))


def unique_count(seq: Column | str = "seq", null_count: int | None = 0) -> Column:
    n = F.size(F.array_distinct(items(seq)))
    return F.when(col(seq).isNotNull(), n).otherwise(F.lit(null_count))


def diversity(unique: Column | str, n: Column | str) -> Column:
    return col(unique) / (col(n) + F.lit(1))


def truncated(seq: Column | str = "seq", n: int = MAX_ITEMS, side: str = "head") -> Column:
    """The first (or last) ``n`` items, still as text."""
    return F.substring_index(col(seq), ",", n if side == "head" else -n)


def numeric(seq: Column | str = "seq") -> Column:
    """Items as floats; a missing or empty sequence is one zero."""
    seq = col(seq)
    parsed = F.transform(items(seq), lambda x: x.try_cast("float"))
    return F.when(F.coalesce(seq, F.lit("")) == "", F.array(F.lit(0.0).cast("float"))).otherwise(parsed)


def padded(codes: Column | str, width: Column) -> Column:
    """Cut or zero-fill a code array to ``width``."""
    codes = F.slice(col(codes), F.lit(1), width)
    return F.concat(codes, F.array_repeat(F.lit(0), width - F.size(codes)))


def mask(codes: Column | str) -> Column:
    return F.transform(col(codes), lambda x: F.when(x != 0, F.lit(1)).otherwise(F.lit(0)))


def positions_from_end(width: Column) -> Column:
    return F.sequence(width - F.lit(1), F.lit(0), F.lit(-1))


def candidate_count(seq: Column | str, candidate: Column | str) -> Column:
    """How often the candidate occurs in the history (0 for a missing history)."""
    wanted = col(candidate).cast("string")
    return F.coalesce(F.size(F.filter(items(seq), lambda x: x == wanted)), F.lit(0))


def candidate_distance(seq: Column | str, candidate: Column | str) -> Column:
    """1 for the newest item, 2 for the one before, ...; 0 if absent."""
    return F.coalesce(
        F.array_position(F.reverse(items(seq)), col(candidate).cast("string")), F.lit(0)
    ).cast("int")
