"""Time-of-day queries."""

from __future__ import annotations

from ...functions import temporal as T
from ...functions.values import safe_double, safe_int, strict_int
from ...sources.impressions import impressions
from .registry import query, r, with_imp

HOUR = 'CAST("hour" AS INTEGER)'


@query("time_segment", with_imp(f"""
SELECT id, CASE WHEN {HOUR} IN (2, 3, 4) THEN 'dawn' WHEN {HOUR} BETWEEN 7 AND 11 THEN 'morning'
  WHEN {HOUR} BETWEEN 12 AND 17 THEN 'afternoon' WHEN {HOUR} BETWEEN 18 AND 20 THEN 'evening'
  WHEN {HOUR} BETWEEN 21 AND 23 THEN 'night' WHEN {HOUR} IN (0, 1) THEN 'midnight'
  WHEN {HOUR} IN (5, 6) THEN 'early' ELSE 'other' END AS time_segment FROM imp"""))
def time_segment(spark, sf):
    return impressions(spark, sf).select("id", T.time_segment(strict_int("hour")).alias("time_segment"))


@query("time_flags", with_imp(f"""
SELECT id, CAST({HOUR} IN (2, 3, 4) AS TINYINT) AS is_dawn, CAST({HOUR} IN (7, 8, 9, 10) AS TINYINT) AS is_morning_rush,
  CAST(CAST(day_of_week AS INTEGER) = 2 AS TINYINT) AS is_tuesday FROM imp"""))
def time_flags(spark, sf):
    hour = strict_int("hour")
    return impressions(spark, sf).select(
        "id",
        T.is_dawn(hour).alias("is_dawn"),
        T.is_morning_rush(hour).alias("is_morning_rush"),
        T.is_tuesday(strict_int("day_of_week")).alias("is_tuesday"),
    )


@query("is_weekend", with_imp("""
SELECT id, CAST(d IN (6, 7) AS TINYINT) AS sat_sun, CAST(d IN (5, 6) AS TINYINT) AS fri_sat, CAST(d >= 5 AS TINYINT) AS from_fri
FROM (SELECT id, CAST(day_of_week AS INTEGER) AS d FROM imp) x"""))
def is_weekend(spark, sf):
    day = safe_int("day_of_week")
    return impressions(spark, sf).select("id", *[T.is_weekend(day, rule).alias(rule) for rule in T.WEEKEND_RULES])


@query("hour_period", with_imp(f"""
SELECT id, CASE WHEN {HOUR} < 6 THEN 0 WHEN {HOUR} < 12 THEN 1 WHEN {HOUR} < 18 THEN 2 ELSE 3 END AS hour_period,
  CASE WHEN {HOUR} < 6 THEN 'dawn' WHEN {HOUR} < 12 THEN 'morning' WHEN {HOUR} < 18 THEN 'afternoon' ELSE 'evening' END AS hour_label
FROM imp"""))
def hour_period(spark, sf):
    period = T.hour_period(safe_double("hour"))
    return impressions(spark, sf).select("id", period.alias("hour_period"), T.hour_label(period).alias("hour_label"))


@query("hour_block", with_imp("""SELECT id, CAST(floor(CAST("hour" AS DOUBLE) / 4) AS VARCHAR) AS hour_block FROM imp"""))
def hour_block(spark, sf):
    return impressions(spark, sf).select("id", T.hour_block(safe_double("hour")).alias("hour_block"))


@query("half_day_flags", with_imp(f"""
SELECT id, CAST({HOUR} >= 6 AND {HOUR} < 12 AS TINYINT) AS is_morning, CAST({HOUR} >= 18 AND {HOUR} < 24 AS TINYINT) AS is_evening
FROM imp"""))
def half_day_flags(spark, sf):
    hour = safe_double("hour")
    return impressions(spark, sf).select(
        "id", T.is_morning(hour).alias("is_morning"), T.is_evening(hour).alias("is_evening")
    )


@query("hour_cycle", with_imp("""
SELECT id, round(sin(h * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(h * 2 * pi() / 24), 6) + 0.0 AS hour_cos
FROM (SELECT id, CAST("hour" AS DOUBLE) AS h FROM imp) x"""))
def hour_cycle(spark, sf):
    hour = safe_double("hour")
    return impressions(spark, sf).select(
        "id", r(T.hour_sin(hour), alias="hour_sin"), r(T.hour_cos(hour), alias="hour_cos")
    )
