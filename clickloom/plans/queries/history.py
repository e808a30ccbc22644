"""History and interaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import cross, history, sequence, values
from ...functions.temporal import hour_block
from ...sources.impressions import impressions
from .registry import query, r, with_imp


@query("history_rate", with_imp("""
SELECT id, round(CASE WHEN history_a_1 > 10 THEN 10 ELSE history_a_1 END, 6) AS history_a_1_clipped,
  round(ln(1 + coalesce(history_a_1, 0)), 6) AS history_a_1_log FROM imp""", "history"))
def history_rate(spark, sf):
    return impressions(spark, sf, "history").select(
        "id",
        r(history.rate_clipped("history_a_1"), alias="history_a_1_clipped"),
        r(history.rate_log("history_a_1"), alias="history_a_1_log"),
    )


@query("history_a_1_bin", with_imp("""
SELECT id, CASE WHEN history_a_1 <= 0.05::DOUBLE THEN 0 WHEN history_a_1 <= 0.1::DOUBLE THEN 1
  WHEN history_a_1 <= 0.2::DOUBLE THEN 2 WHEN history_a_1 <= 1.0::DOUBLE THEN 3 ELSE 4 END AS history_a_1_bin FROM imp""", "history"))
def history_a_1_bin(spark, sf):
    return impressions(spark, sf, "history").select("id", history.rate_bin("history_a_1").alias("history_a_1_bin"))


@query("history_rate_flags", with_imp("""
SELECT id, CAST(history_a_1 > 0.2::DOUBLE AS TINYINT) AS history_a_1_high,
  CAST(history_a_1 > 1.0::DOUBLE AS TINYINT) AS history_a_1_very_high,
  CAST(coalesce(history_a_1 > 0.2::DOUBLE, false) AS TINYINT) AS high_or_zero FROM imp""", "history"))
def history_rate_flags(spark, sf):
    h = "history_a_1"
    return impressions(spark, sf, "history").select(
        "id",
        history.above(h, history.RATE_HIGH).alias("history_a_1_high"),
        history.above(h, history.RATE_VERY_HIGH).alias("history_a_1_very_high"),
        history.above(h, history.RATE_HIGH, 0).alias("high_or_zero"),
    )


@query("history_depth", with_imp("""
SELECT id, round(CASE WHEN history_a_4 < -5000 THEN -5000 ELSE history_a_4 END, 4) AS history_a_4_clipped,
  CAST(history_a_4 > -200 AS TINYINT) AS history_a_4_near_zero,
  CASE WHEN history_a_4 <= -1000 THEN 0 WHEN history_a_4 <= -500 THEN 1 WHEN history_a_4 <= -200 THEN 2 ELSE 3 END AS history_a_4_bin
FROM imp""", "history"))
def history_depth(spark, sf):
    h = "history_a_4"
    return impressions(spark, sf, "history").select(
        "id",
        r(history.depth_clipped(h), 4, "history_a_4_clipped"),
        history.above(h, history.DEPTH_NEAR_ZERO).alias("history_a_4_near_zero"),
        history.depth_bin(h).alias("history_a_4_bin"),
    )


@query("hist_delta", with_imp("""
SELECT id, round(history_a_1 - history_a_3, 6) AS hist_a_delta_13, history_b_1 - history_b_3 AS hist_b_delta_13
FROM imp""", "history", "orders"))
def hist_delta(spark, sf):
    return impressions(spark, sf, "history", "orders").select(
        "id",
        r(history.delta("history_a_1", "history_a_3"), alias="hist_a_delta_13"),
        history.delta("history_b_1", "history_b_3").alias("hist_b_delta_13"),
    )


@query("hist_ratio", with_imp("""
SELECT id, round(history_a_1 / (history_a_3 + 1e-6), 3) AS hist_a_ratio_13,
  round(history_b_1 / (history_b_3 + 1e-6), 3) AS hist_b_ratio_13
FROM imp""", "history", "orders"))
def hist_ratio(spark, sf):
    return impressions(spark, sf, "history", "orders").select(
        "id",
        r(history.shift_ratio("history_a_1", "history_a_3"), 3, "hist_a_ratio_13"),
        r(history.shift_ratio("history_b_1", "history_b_3"), 3, "hist_b_ratio_13"),
    )


@query("history_trend", with_imp("""
SELECT id, CAST(coalesce(sign(history_a_1 - history_a_3), 0) AS INTEGER) AS history_a_trend,
  CAST(coalesce(sign(history_b_1 - history_b_3), 0) AS INTEGER) AS history_b_trend
FROM imp""", "history", "orders"))
def history_trend(spark, sf):
    return impressions(spark, sf, "history", "orders").select(
        "id",
        history.trend("history_a_1", "history_a_3").alias("history_a_trend"),
        history.trend("history_b_1", "history_b_3").alias("history_b_trend"),
    )


@query("l_feat_ratio", with_imp("""
SELECT id, round(CAST(l_feat_1 AS DOUBLE) / (l_feat_14 + 1e-6), 4) AS l_feat_ratio_1_14 FROM imp"""))
def l_feat_ratio(spark, sf):
    return impressions(spark, sf).select("id", r(values.ratio("l_feat_1", "l_feat_14"), 4, "l_feat_ratio_1_14"))


@query("rate_by_length", with_imp("""
SELECT id, round(history_a_1 * ln(1 + n), 6) AS h1_x_seqlen, round(ln(2 + history_a_1 * ln(1 + n)), 6) AS h1_x_seqlen_log
FROM (SELECT id, history_a_1, len(string_split(seq, ',')) AS n FROM imp) x""", "history", "seq"))
def rate_by_length(spark, sf):
    n = sequence.length("seq")
    return impressions(spark, sf, "history", "seq").select(
        "id",
        r(cross.rate_by_length("history_a_1", n), alias="h1_x_seqlen"),
        r(cross.rate_by_length_log("history_a_1", n), alias="h1_x_seqlen_log"),
    )


@query("age_hour", with_imp("""SELECT id, age_group || '_' || "hour" AS age_hour FROM imp""", "users"))
def age_hour(spark, sf):
    return impressions(spark, sf, "users").select("id", cross.joined_text("age_group", "hour").alias("age_hour"))


@query("day_hour_cross", with_imp("""
SELECT id, CAST(CAST(day_of_week AS DOUBLE) AS VARCHAR) || '_' || CAST(floor(CAST("hour" AS DOUBLE) / 4) AS VARCHAR) AS day_hour_cross
FROM imp"""))
def day_hour_cross(spark, sf):
    return impressions(spark, sf).select(
        "id",
        cross.day_hour(values.safe_double("day_of_week"), values.safe_double("hour")).alias("day_hour_cross"),
    )


@query("inventory_cross", with_imp("""
SELECT id, inventory_id || '_' || age_group AS inv_age_cross,
  inventory_id || '_' || CAST(floor(CAST("hour" AS DOUBLE) / 4) AS VARCHAR) AS inv_hour_cross,
  inventory_id || '_' || gender AS inv_gender_cross,
  coalesce(inventory_id || '_' || gender, '') AS inv_gender_filled
FROM imp""", "users"))
def inventory_cross(spark, sf):
    by_gender = cross.joined_text("inventory_id", "gender")
    return impressions(spark, sf, "users").select(
        "id",
        cross.joined_text("inventory_id", "age_group").alias("inv_age_cross"),
        cross.joined_text("inventory_id", hour_block(values.safe_double("hour"))).alias("inv_hour_cross"),
        by_gender.alias("inv_gender_cross"),
        F.coalesce(by_gender, F.lit("")).alias("inv_gender_filled"),
    )


@query("hash_cross", with_imp("""
SELECT id, CAST(CAST('0x' || substr(md5(gender || '_' || "hour"), 1, 8) AS BIGINT) % 100000 AS INTEGER) AS cross_gender_hour,
  CAST(CAST('0x' || substr(md5(inventory_id || '_' || CAST(l_feat_14 AS VARCHAR)), 1, 8) AS BIGINT) % 1000 AS INTEGER) AS cross_inventory_ad
FROM imp""", "users"))
def hash_cross(spark, sf):
    return impressions(spark, sf, "users").select(
        "id",
        cross.hash_cross("gender", "hour").alias("cross_gender_hour"),
        cross.hash_cross("inventory_id", "l_feat_14", 1000).alias("cross_inventory_ad"),
    )
