"""Expressions over hour and day of week."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, flag

# Named parts of the day and the three weekend rules in use.
SEGMENTS = {
    "dawn": (2, 3, 4),
    "morning": (7, 8, 9, 10, 11),
    "afternoon": (12, 13, 14, 15, 16, 17),
    "evening": (18, 19, 20),
    "night": (21, 22, 23),
    "midnight": (0, 1),
    "early": (5, 6),
}
DAWN_HOURS = (2, 3, 4)
MORNING_RUSH_HOURS = (7, 8, 9, 10)
HOUR_EDGES = (0, 6, 12, 18, 24)
HOUR_LABELS = ("dawn", "morning", "afternoon", "evening")
WEEKEND_RULES = {"sat_sun": (6, 7), "fri_sat": (5, 6), "from_fri": None}


def time_segment(hour: Column | str) -> Column:
    hour = col(hour)
    out = None
    for name, hours in SEGMENTS.items():
        hit = hour.isin(*hours)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("other"))


def is_dawn(hour: Column | str) -> Column:
    return flag(col(hour).isin(*DAWN_HOURS))


def is_morning_rush(hour: Column | str) -> Column:
    return flag(col(hour).isin(*MORNING_RUSH_HOURS))


def is_tuesday(day: Column | str) -> Column:
    return flag(col(day) == 2)


def is_weekend(day: Column | str, rule: str = "sat_sun") -> Column:
    """``sat_sun`` is {6,7}, ``fri_sat`` is {5,6}, ``from_fri`` is >= 5."""
    days = WEEKEND_RULES[rule]
    return flag(col(day) >= 5) if days is None else flag(col(day).isin(*days))


def hour_period(hour: Column | str, edges: tuple[int, ...] = HOUR_EDGES) -> Column:
    """Number of inner edges at or below the hour; null stays null."""
    hour = col(hour)
    inner = edges[1:-1]
    out = F.when(hour.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(inner):
        out = out.when(hour < F.lit(edge), F.lit(i))
    return out.otherwise(F.lit(len(inner)))


def hour_label(period: Column | str, labels: tuple[str, ...] = HOUR_LABELS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), col(period) + F.lit(1))


def hour_block(hour: Column | str) -> Column:
    """Four-hour block as the text of a double, e.g. ``3.0``."""
    return F.floor(col(hour) / F.lit(4)).cast("double").cast("string")


def is_morning(hour: Column | str) -> Column:
    return flag((col(hour) >= 6) & (col(hour) < 12))


def is_evening(hour: Column | str) -> Column:
    return flag((col(hour) >= 18) & (col(hour) < 24))


def hour_sin(hour: Column | str) -> Column:
    return F.sin(col(hour).cast("double") * F.lit(2 * math.pi / 24))


def hour_cos(hour: Column | str) -> Column:
    return F.cos(col(hour).cast("double") * F.lit(2 * math.pi / 24))
