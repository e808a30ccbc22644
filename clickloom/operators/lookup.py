"""Joining small tables to wide rows without moving the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32


def fits(table: DataFrame, text: str = "value", limit: int = BROADCAST_BYTES) -> bool:
    """Measured size of a stored lookup table against a limit."""
    size = F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD), F.lit(0))
    return table.agg(size).first()[0] <= limit


def lookup_sides(
    table: DataFrame, columns: Sequence[str], limit: int = BROADCAST_BYTES
) -> Iterator[tuple[str, DataFrame]]:
    """The part of a stored <column, value, ...> table for each column, ready to be joined.

    A part is marked for broadcast only if it is measured to be small. Left to
    itself Spark learns the size of a computed table only after it has started
    to shuffle the wide side as well. Larger parts carry no hint: the join is an
    ordinary one, whose hot keys adaptive execution splits.
    """
    all_fit = fits(table, "value", limit)
    for c in columns:
        side = table.where(F.col("column") == c)
        yield c, F.broadcast(side) if all_fit or fits(side, "value", limit) else side
