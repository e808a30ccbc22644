"""Casts, filters, missing values, column selection, and the whole feature plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import values as V
from ...sources.impressions import impressions, table
from .. import features
from .registry import NUDGE, query, r, with_imp


@query("ctr_by_segment", with_imp("""
SELECT time_segment, seq_length_bin, history_a_1_bin, count(*) AS n_rows, CAST(sum(clicked) AS BIGINT) AS clicks,
  round(avg(clicked), 6) AS ctr
FROM (SELECT clicked,
    CASE WHEN h IN (2, 3, 4) THEN 'dawn' WHEN h BETWEEN 7 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 17 THEN 'afternoon'
      WHEN h BETWEEN 18 AND 20 THEN 'evening' WHEN h BETWEEN 21 AND 23 THEN 'night' WHEN h < 2 THEN 'midnight' ELSE 'early' END AS time_segment,
    CASE WHEN n <= 5 THEN 0 WHEN n <= 20 THEN 1 WHEN n <= 40 THEN 2 WHEN n <= 60 THEN 3 ELSE 4 END AS seq_length_bin,
    CASE WHEN a <= 0.05::DOUBLE THEN 0 WHEN a <= 0.1::DOUBLE THEN 1 WHEN a <= 0.2::DOUBLE THEN 2 WHEN a <= 1 THEN 3 ELSE 4 END AS history_a_1_bin
  FROM (SELECT clicked, CAST("hour" AS INTEGER) AS h, len(string_split(seq, ',')) AS n, history_a_1 AS a FROM imp) y) x
GROUP BY ALL""", "history", "seq"))
def ctr_by_segment(spark, sf):
    """Click rate by part of day, history length and history rate."""
    df = features.sequence_features(impressions(spark, sf, "history", "seq"), edges=(5, 20, 40, 60))
    df = features.time_features(features.history_features(df))
    return df.groupBy("time_segment", "seq_length_bin", "history_a_1_bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("clicked").alias("clicks"), r(F.avg("clicked"), alias="ctr")
    )


@query("feature_columns", with_imp("""
SELECT id, clicked, l_feat_1, l_feat_2, l_feat_3, l_feat_8, l_feat_14, age_group, inventory_id FROM imp""", "users"))
def feature_columns(spark, sf):
    """Everything except key, target and working columns, chosen from the column names."""
    df = impressions(spark, sf, "users")
    chosen = features.feature_columns(df, ("id", "clicked", "seq", "user_id", "ts", "day", "event_type", "value", "feat_b_1"))
    keep = [c for c in chosen if c.startswith("l_feat_") or c in ("age_group", "inventory_id")]
    return df.select("id", "clicked", *keep)


@query("prefix_groups", with_imp("""
SELECT id, round(coalesce(feat_c_1, 0) + coalesce(feat_c_2, 0) + coalesce(feat_c_3, 0), 6) AS feat_c_sum,
  round(coalesce(feat_d_1, 0) + coalesce(feat_d_2, 0), 2) AS feat_d_sum FROM imp""", "orders"))
def prefix_groups(spark, sf):
    """Groups found by prefix; groups without columns are skipped."""
    df = impressions(spark, sf, "orders")
    groups = {p: (features.with_prefix(df, p), ("sum",)) for p in features.GROUPS}
    return features.group_stats(df, groups).select("id", r("feat_c_sum"), r("feat_d_sum", 2))


@query("strict_cast", with_imp("""
SELECT id, CAST("hour" AS INTEGER) AS "hour", CAST(day_of_week AS INTEGER) AS day_of_week FROM imp"""))
def strict_cast(spark, sf):
    return impressions(spark, sf).select(
        "id", V.strict_int("hour").alias("hour"), V.strict_int("day_of_week").alias("day_of_week")
    )


@query("safe_cast", with_imp("""
SELECT id, TRY_CAST(TRY_CAST(gender AS DOUBLE) AS INTEGER) AS gender, TRY_CAST(inventory_id AS DOUBLE) AS inventory_id,
  TRY_CAST(TRY_CAST(age_group AS DOUBLE) AS INTEGER) AS age_group FROM imp""", "users"))
def safe_cast(spark, sf):
    return impressions(spark, sf, "users").select(
        "id",
        V.safe_int("gender").alias("gender"),
        V.safe_double("inventory_id").alias("inventory_id"),
        V.safe_int("age_group").alias("age_group"),
    )


@query("fill_missing", with_imp("""
SELECT id, coalesce(gender, '__MISSING__') AS gender, coalesce(inventory_id, 'UNK') AS inventory_id,
  coalesce(CAST(l_feat_8 AS VARCHAR), '') AS l_feat_8 FROM imp""", "users"))
def fill_missing(spark, sf):
    return impressions(spark, sf, "users").select(
        "id",
        V.fill_text("gender").alias("gender"),
        V.fill_text("inventory_id", "UNK").alias("inventory_id"),
        V.fill_text("l_feat_8", "").alias("l_feat_8"),
    )


@query("fill_numeric", with_imp(f"""
SELECT id, round(coalesce(history_a_1, 0), 6) AS history_a_1, round(coalesce(feat_b_2, 0) + {NUDGE}, 4) AS feat_b_2,
  coalesce(l_feat_8, 0) AS l_feat_8 FROM imp""", "history"))
def fill_numeric(spark, sf):
    df = impressions(spark, sf, "history").select("id", "history_a_1", "feat_b_2", "l_feat_8")
    return features.fill_missing(df).select("id", r("history_a_1"), r("feat_b_2", 4, nudge=NUDGE), "l_feat_8")


CENSUS = ("gender", "inventory_id", "l_feat_8", "history_a_1", "feat_b_2", "seq")


@query("null_counts", with_imp("SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in CENSUS) + " FROM imp", "users", "history", "seq"))
def null_counts(spark, sf):
    return features.null_counts(impressions(spark, sf, "users", "history", "seq"), CENSUS)


@query("clip", with_imp("""
SELECT id, CASE WHEN value > 10 THEN 10 ELSE value END AS upper, CASE WHEN feat_b_1 < 0 THEN 0 ELSE feat_b_1 END AS lower,
  CASE WHEN history_a_1 > 1 THEN 1 WHEN history_a_1 < 1e-15 THEN 1e-15 ELSE round(history_a_1, 6) END AS both
FROM imp""", "users", "history"))
def clip(spark, sf):
    h = F.round("history_a_1", 6)
    return impressions(spark, sf, "users", "history").select(
        "id",
        V.clip("value", upper=10.0).alias("upper"),
        V.clip("feat_b_1", lower=0.0).alias("lower"),
        V.clip(h, 1e-15, 1.0).alias("both"),
    )


@query("binary_flags", with_imp("SELECT id, coalesce(l_feat_1, 0) AS l_feat_1, coalesce(l_feat_8, 0) AS l_feat_8 FROM imp"))
def binary_flags(spark, sf):
    df = features.native_tree_inputs(impressions(spark, sf).select("id", "l_feat_1", "l_feat_8"))
    return df.select("id", "l_feat_1", "l_feat_8")


@query("text_columns", with_imp("""
SELECT id, age_group, day_of_week, event_type, gender, "hour", inventory_id FROM imp""", "users"))
def text_columns(spark, sf):
    """Categories found by type: every text column of the table."""
    df = impressions(spark, sf, "users")
    return df.select("id", *sorted(features.text_columns(df)))


@query("drop_columns", with_imp("SELECT id, day_of_week, gender, \"hour\", l_feat_1, l_feat_8, l_feat_14 FROM imp"))
def drop_columns(spark, sf):
    return impressions(spark, sf).drop("ts", "day", "clicked", "user_id", "event_type", "value")


@query("class_filter", with_imp("""
SELECT clicked, count(*) AS n_rows, round(avg(value), 4) AS mean_value FROM imp GROUP BY clicked"""))
def class_filter(spark, sf):
    """Both classes from one scan, not two filtered scans."""
    return impressions(spark, sf).groupBy("clicked").agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.avg("value"), 4, "mean_value")
    )


TREE_SQL = with_imp(f"""
SELECT id, clicked, n AS seq_length, CASE WHEN n <= 100 THEN 0 WHEN n <= 200 THEN 1 WHEN n <= 500 THEN 2 WHEN n <= 1000 THEN 3 ELSE 4 END AS seq_length_bin,
  round(ln(1 + n), 6) AS seq_length_log, CAST(contains(seq, ',74,') AS TINYINT) AS seq_has_74,
  CASE WHEN a1 <= 0.05::DOUBLE THEN 0 WHEN a1 <= 0.1::DOUBLE THEN 1 WHEN a1 <= 0.2::DOUBLE THEN 2 WHEN a1 <= 1 THEN 3 ELSE 4 END AS history_a_1_bin,
  CAST(h IN (2, 3, 4) AS TINYINT) AS is_dawn, CAST(d IN (6, 7) AS TINYINT) AS is_weekend,
  round(a1 * ln(1 + n), 6) AS h1_x_seqlen, age_group || '_' || "hour" AS age_hour,
  round(list_avg([history_a_1, history_a_2, history_a_3, history_a_4]) + {NUDGE}, 4) AS history_a_mean,
  round(list_aggregate([feat_a_1, feat_a_2, feat_a_3], 'stddev_samp'), 4) AS feat_a_std,
  round(greatest(feat_b_1, feat_b_2), 4) AS feat_b_max,
  round(list_avg([feat_e_1, feat_e_2]) + {NUDGE}, 4) AS feat_e_mean
FROM (SELECT *, len(string_split(seq, ',')) AS n, history_a_1 AS a1, CAST("hour" AS INTEGER) AS h, CAST(day_of_week AS INTEGER) AS d FROM imp) x""",
    "users", "orders", "history", "seq")


@query("tree_features", TREE_SQL)
def tree_features(spark, sf):
    """Every row-local feature of the boosted-tree plan in one projection chain."""
    df = features.tree_features(impressions(spark, sf, "users", "orders", "history", "seq"))
    return df.select(
        "id", "clicked", F.col("seq_length").cast("bigint").alias("seq_length"), "seq_length_bin", r("seq_length_log"), "seq_has_74", "history_a_1_bin",
        "is_dawn", "is_weekend", r("h1_x_seqlen"), "age_hour", r("history_a_mean", 4, nudge=NUDGE), r("feat_a_std", 4),
        r("feat_b_max", 4), r("feat_e_mean", 4, nudge=NUDGE),
    )


@query("deep_features", with_imp("""
SELECT id, round(ln(1 + coalesce(history_a_1, 0)), 6) AS history_a_1_log,
  CAST(coalesce(history_a_1 > 0.2::DOUBLE, false) AS TINYINT) AS history_a_1_high,
  CAST(coalesce(history_a_4 > -200, false) AS TINYINT) AS history_a_4_near_zero,
  CAST(CAST("hour" AS INTEGER) IN (7, 8, 9, 10) AS TINYINT) AS is_morning_rush,
  CAST(coalesce(len(string_split(seq, ',')), 0) AS BIGINT) AS seq_length,
  CAST(coalesce(len(list_distinct(string_split(seq, ','))), 0) AS INTEGER) AS seq_unique_count,
  round(coalesce(len(list_distinct(string_split(seq, ','))), 0) / CAST(coalesce(len(string_split(seq, ',')), 0) + 1 AS DOUBLE), 6) AS seq_diversity
FROM imp""", "history", "seq"))
def deep_features(spark, sf):
    df = features.deep_features(impressions(spark, sf, "history", "seq"))
    return df.select(
        "id", r("history_a_1_log"), "history_a_1_high", "history_a_4_near_zero", "is_morning_rush",
        F.col("seq_length").cast("bigint").alias("seq_length"), "seq_unique_count", r("seq_diversity"),
    )


TWO_STAGE_SQL = with_imp("""
SELECT id, coalesce(gender, '__MISSING__') AS gender, day_of_week || '.0_' || CAST(floor(h / 4) AS VARCHAR) AS day_hour_cross,
  CAST(CAST(day_of_week AS INTEGER) >= 5 AS TINYINT) AS is_weekend,
  CAST(CASE WHEN h < 6 THEN 0 WHEN h < 12 THEN 1 WHEN h < 18 THEN 2 ELSE 3 END AS INTEGER) AS hour_period,
  coalesce(inventory_id || '_' || gender, '') AS inv_gender_cross,
  round(coalesce((SELECT count(*) FROM us_ev u WHERE u.inventory_id = x.inventory_id) / CAST((SELECT count(*) FROM ev) AS DOUBLE), 0), 6) AS inventory_id_freq,
  round(coalesce(history_a_1 - history_a_3, 0), 6) AS hist_a_delta_13,
  CAST(coalesce(sign(history_a_1 - history_a_3), 0) AS INTEGER) AS history_a_trend,
  round(CAST(coalesce(feat_c_1, 0) + coalesce(feat_c_2, 0) + coalesce(feat_c_3, 0) AS DOUBLE), 2) AS feat_c_sum,
  CAST(CAST(coalesce(list_aggregate([history_b_1, history_b_2, history_b_3], 'max'), 0) AS FLOAT) AS DOUBLE) AS history_b_max
FROM (SELECT *, CAST("hour" AS DOUBLE) AS h FROM imp) x""", "users", "orders", "history").replace(
    "\nimp AS", "\nus_ev AS (SELECT us.inventory_id FROM ev JOIN us ON ev.user_id = us.user_id),\nimp AS")


@query("two_stage_features", TWO_STAGE_SQL)
def two_stage_features(spark, sf):
    df = features.two_stage_features(impressions(spark, sf, "users", "orders", "history"))
    return df.select(
        "id", "gender", "day_hour_cross", "is_weekend", "hour_period", "inv_gender_cross", r("inventory_id_freq"),
        r("hist_a_delta_13"), "history_a_trend", r("feat_c_sum", 2), F.col("history_b_max").cast("double").alias("history_b_max"),
    )


@query("label_by_source", """
SELECT d.source, count(*) AS n_rows, CAST(sum(l.quality) AS BIGINT) AS good, round(avg(l.toxic), 6) AS toxic_rate
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source""")
def label_by_source(spark, sf):
    """Positive rates of a second labelled table."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quality").alias("good"), r(F.avg("toxic"), alias="toxic_rate"))
    )
