"""Row-wise statistics over a group of columns.

Everything is made of plain arithmetic, so the projection stays generated code;
array lambdas would be interpreted. The expressions are assembled as SQL text:
a group of 30 columns is one parsed expression instead of hundreds of calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("mean", "std", "max", "min", "sum")


def _name(c: str) -> str:
    return f"`{c}`"


def _doubles(cols: Sequence[str], dtype: str) -> list[str]:
    return [f"cast(cast({_name(c)} as {dtype}) as double)" for c in cols]


def _sum(cols: Sequence[str], dtype: str) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0D)" for c in _doubles(cols, dtype)) + ")"


def _count(cols: Sequence[str]) -> str:
    return "(" + " + ".join(f"if({_name(c)} is null, 0, 1)" for c in cols) + ")"


def row_count(cols: Sequence[str]) -> Column:
    """Non-null values in the row."""
    return F.expr(_count(cols))


def row_sum(cols: Sequence[str], dtype: str = "double") -> Column:
    """Sum that skips nulls; the sum of nothing is 0."""
    return F.expr(_sum(cols, dtype))


def row_mean(cols: Sequence[str], dtype: str = "double") -> Column:
    return F.expr(f"{_sum(cols, dtype)} / nullif({_count(cols)}, 0)")


def row_max(cols: Sequence[str], dtype: str = "double") -> Column:
    parts = _doubles(cols, dtype)
    return F.expr(f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0])


def row_min(cols: Sequence[str], dtype: str = "double") -> Column:
    parts = _doubles(cols, dtype)
    return F.expr(f"least({', '.join(parts)})" if len(parts) > 1 else parts[0])


def row_std(cols: Sequence[str], mean: str, count: str, dtype: str = "double") -> Column:
    """Sample deviation from already computed mean and count columns; null below two values."""
    squares = " + ".join(
        f"coalesce(({c} - {_name(mean)}) * ({c} - {_name(mean)}), 0D)" for c in _doubles(cols, dtype)
    )
    return F.expr(f"sqrt(({squares}) / nullif(greatest({_name(count)} - 1, 0), 0))")


def row_std_population(cols: Sequence[str], mean: str) -> Column:
    """sqrt(max(E[x^2] - E[x]^2, 0)), nulls skipped; unknown variance counts as 0."""
    squares = " + ".join(f"coalesce({c} * {c}, 0D)" for c in _doubles(cols, "double"))
    variance = f"(({squares}) / nullif({_count(cols)}, 0) - {_name(mean)} * {_name(mean)})"
    return F.expr(f"sqrt(if({variance} > 0, {variance}, 0D))")


def nonzero_count(cols: Sequence[str]) -> Column:
    return F.expr("(" + " + ".join(f"if({_name(c)} != 0, 1, 0)" for c in cols) + ")")
