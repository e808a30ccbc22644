"""Join, aggregate, sort and union queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.sequence import truncated
from ...functions.values import fill_text
from ...operators import encode, ensemble, metrics
from ...operators.lookup import fits
from ...session import cut_lineage
from ...sources.impressions import (
    PREDICTION_MODELS,
    fold_predictions,
    impressions,
    is_train,
    model_predictions,
    table,
    tied_predictions,
    word_sequences,
)
from .registry import FOLD_PREDS, MODELS, TIED, query, r, with_imp, with_words


@query("ensemble_join", f"""WITH {MODELS}
SELECT a.id, round(0.5 * a.clicked + 0.3 * b.clicked + 0.2 * c.clicked, 6) AS clicked
FROM sub_a a JOIN sub_b b ON a.id = b.id JOIN sub_c c ON a.id = c.id""")
def ensemble_join(spark, sf):
    tables = {m: model_predictions(spark, sf, m) for m in PREDICTION_MODELS}
    return ensemble.chained_blend(tables, {"a": 0.5, "b": 0.3, "c": 0.2}).select("id", r("clicked"))


@query("freq_join", with_imp("""
SELECT i.id, i.inventory_id, f.n AS inventory_rows FROM imp i
LEFT JOIN (SELECT inventory_id, count(*) AS n FROM imp GROUP BY inventory_id) f ON f.inventory_id = i.inventory_id""", "users"))
def freq_join(spark, sf):
    rows = impressions(spark, sf, "users").select("id", "inventory_id")
    counts = cut_lineage(encode.value_counts(rows, "inventory_id").withColumnRenamed("count", "inventory_rows"))
    counts = F.broadcast(counts) if fits(counts, "inventory_id") else counts
    return rows.join(counts, "inventory_id", "left").select("id", "inventory_id", "inventory_rows")


@query("lookup_join", """
SELECT d.doc_id AS id, d.lang, v.code AS lang_code FROM documents d
LEFT JOIN (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 3 = 0) x) v
  ON v.lang = d.lang""")
def lookup_join(spark, sf):
    """Codes fitted on part of the rows and looked up for all; unseen values stay null."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    codes = encode.label_table([docs.where(F.col("id") % 3 == 0)], ["lang"], unknown=None)
    return encode.apply_labels(docs, codes, ["lang"])


@query("value_counts", with_imp('SELECT inventory_id, count(*) AS "count" FROM imp GROUP BY inventory_id', "users"))
def value_counts(spark, sf):
    return encode.value_counts(impressions(spark, sf, "users"), "inventory_id")


@query("submission_stats", f"""WITH {MODELS}
SELECT count(*) AS n_rows, round(min(clicked), 6) AS min_value, round(max(clicked), 6) AS max_value, round(avg(clicked), 6) AS avg_value FROM sub_a""")
def submission_stats(spark, sf):
    stats = ensemble.submission_stats(model_predictions(spark, sf, "a"))
    return stats.select("n_rows", r("min_value"), r("max_value"), r("avg_value"))


@query("prediction_stats", f"""WITH {FOLD_PREDS}
SELECT model, fold, round(avg(pred), 8) AS mean, round(stddev_pop(pred), 6) AS std FROM preds GROUP BY model, fold""")
def prediction_stats(spark, sf):
    return ensemble.prediction_stats(fold_predictions(spark, sf)).select("model", "fold", r("mean", 8), r("std"))


@query("positive_rate", with_imp("""
SELECT count(*) AS n_rows, CAST(sum(clicked) AS BIGINT) AS positives, count(*) - CAST(sum(clicked) AS BIGINT) AS negatives,
  round(avg(clicked), 6) AS rate FROM imp"""))
def positive_rate(spark, sf):
    y = F.col("clicked")
    return impressions(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(y).alias("positives"),
        (F.count(F.lit(1)) - F.sum(y)).alias("negatives"),
        r(F.avg(y), alias="rate"),
    )


@query("distinct_items", with_words("SELECT DISTINCT unnest(string_split(seq, ',')) AS item FROM docs WHERE seq <> ''"))
def distinct_items(spark, sf):
    return encode.distinct_items(word_sequences(spark, sf))


@query("fold_median", f"""WITH {FOLD_PREDS}
SELECT id, model, round(median(pred), 6) AS pred FROM preds GROUP BY id, model""")
def fold_median(spark, sf):
    return ensemble.fold_median(fold_predictions(spark, sf), folds=range(1, 6)).select("id", "model", r("pred"))


@query("fold_median_any", f"""WITH {FOLD_PREDS}
SELECT id, model, round(median(pred), 6) AS pred FROM preds WHERE NOT (model = 'b' AND fold = 4) GROUP BY id, model""")
def fold_median_any(spark, sf):
    """Folds not known in advance; one model lacks a fold, so its median is a mean of two."""
    preds = fold_predictions(spark, sf).where(~((F.col("model") == "b") & (F.col("fold") == 4)))
    return ensemble.fold_median(preds).select("id", "model", r("pred"))


@query("fold_mean", f"""WITH {FOLD_PREDS}
SELECT id, model, round(avg(pred), 8) AS pred FROM preds WHERE NOT (model = 'c' AND fold = 2) GROUP BY id, model""")
def fold_mean(spark, sf):
    """One fold of one model is missing and is skipped."""
    preds = fold_predictions(spark, sf).where(~((F.col("model") == "c") & (F.col("fold") == 2)))
    return ensemble.fold_mean(preds).select("id", "model", r("pred", 8))


@query("cumulative_counts", f"""WITH {TIED}
SELECT round(s, 6) AS score, CAST(sum(count(*)) OVER w AS BIGINT) AS cum_n, CAST(sum(sum(y)) OVER w AS BIGINT) AS cum_tp
FROM tied GROUP BY s WINDOW w AS (ORDER BY s DESC)""")
def cumulative_counts(spark, sf):
    counts = metrics.cumulative_counts(tied_predictions(spark, sf), "y", "s")
    return counts.select(r("score"), "cum_n", "cum_tp")


@query("order_by_key", f"""WITH {MODELS} SELECT id, round(clicked, 6) AS clicked FROM sub_a ORDER BY id""")
def order_by_key(spark, sf):
    return model_predictions(spark, sf, "a").select("id", r("clicked")).orderBy("id")


@query("sorted_values", with_imp("""
SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT age_group || '_' || "hour" AS value FROM imp) x""", "users"))
def sorted_values(spark, sf):
    """Distinct text values numbered in text order."""
    rows = impressions(spark, sf, "users")
    values = rows.select(F.concat("age_group", F.lit("_"), "hour").alias("v"))
    return encode.label_table([values], ["v"]).select("value", "code")


@query("first_items", with_words("SELECT id, array_to_string(string_split(seq, ',')[1:5], ',') AS head FROM docs"))
def first_items(spark, sf):
    return word_sequences(spark, sf).select("id", truncated("seq", 5).alias("head"))


@query("train_test_union", with_imp("""
SELECT value, bool_or(is_train) AS in_train, bool_or(NOT is_train) AS in_test, count(*) AS n_rows FROM (
  SELECT coalesce(inventory_id, 'UNK') AS value, day < DATE '2024-01-25' AS is_train FROM imp) x GROUP BY value""", "users"))
def train_test_union(spark, sf):
    rows = impressions(spark, sf, "users")
    value = fill_text("inventory_id", "UNK").alias("value")
    both = rows.where(is_train()).select(value, F.lit(True).alias("t")).unionByName(
        rows.where(~is_train()).select(value, F.lit(False).alias("t"))
    )
    return both.groupBy("value").agg(
        F.bool_or("t").alias("in_train"), F.bool_or(~F.col("t")).alias("in_test"), F.count(F.lit(1)).alias("n_rows")
    )
