"""Casts, missing-value rules, clipping and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_int(c: Column | str) -> Column:
    """Text or number to int; bad text stops the job (ANSI mode)."""
    return col(c).cast("int")


def safe_double(c: Column | str) -> Column:
    """Text or number to double; bad text becomes null."""
    return col(c).try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Text such as ``5``, ``5.0`` or `` 5`` to int; anything else becomes null."""
    return safe_double(c).try_cast("int")


def fill_text(c: Column | str, marker: str = MISSING) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(marker))


def fill_number(c: Column | str, value: float = 0.0) -> Column:
    """Null and NaN to ``value``."""
    c = col(c)
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(float(value))), F.lit(float(value)))


def nan_to(c: Column | str, value: float = 0.0) -> Column:
    """NaN to ``value``; null stays null."""
    return F.nanvl(col(c), F.lit(float(value)))


def clip(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value. Null stays null and NaN stays NaN (``least`` would hide both)."""
    c = col(c)
    out = F.when(F.isnan(c), c)
    if upper is not None:
        out = out.when(c > F.lit(upper), F.lit(upper))
    if lower is not None:
        out = out.when(c < F.lit(lower), F.lit(lower))
    return out.otherwise(c)


def flag(condition: Column) -> Column:
    """Condition to 1/0 as a tiny int; null stays null."""
    return condition.cast("tinyint")


def binary_flag(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0)).cast("int")


def ratio(numerator: Column | str, denominator: Column | str, eps: float = 1e-6) -> Column:
    """``a / (b + eps)`` with NaN to 0; a zero divisor gives null instead of an error."""
    return nan_to(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double") + F.lit(eps)))


def upper_bins(c: Column | str, edges: tuple[float, ...]) -> Column:
    """Index of the first edge that is >= the value; past the last edge, and null, is ``len(edges)``."""
    c = col(c)
    out = None
    for i, edge in enumerate(edges):
        hit = c <= F.lit(edge)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))
