"""Fold, weight and noise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import folds
from ...sources.impressions import impressions, table
from .. import training
from .registry import hash_sql, query, r, with_imp


@query("stratified_folds", with_imp("""
SELECT id, clicked, CAST((row_number() OVER (PARTITION BY clicked ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1) % 5 + 1 AS INTEGER) AS fold
FROM imp"""))
def stratified_folds(spark, sf):
    return folds.stratified_folds(impressions(spark, sf))


@query("fold_balance", with_imp("""
SELECT fold, count(*) AS n_rows, CAST(sum(clicked) AS BIGINT) AS positives FROM (
  SELECT clicked, CAST((row_number() OVER (PARTITION BY clicked ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1) % 5 + 1 AS INTEGER) AS fold
  FROM imp) x GROUP BY fold"""))
def fold_balance(spark, sf):
    return (
        folds.stratified_folds(impressions(spark, sf))
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("clicked").alias("positives"))
    )


@query("fold_cuts", with_imp("""
SELECT id, clicked, CAST(ntile(5) OVER (PARTITION BY clicked ORDER BY md5(CAST(id AS VARCHAR) || '42') || CAST(id AS VARCHAR)) AS INTEGER) AS fold
FROM imp"""))
def fold_cuts(spark, sf):
    """Folds as cuts of the hash order: assigned row by row, without moving rows."""
    return training.with_folds(impressions(spark, sf).select("id", "clicked"))


@query("class_weight_ratio", with_imp("""
SELECT clicked, count(*) AS n, round(CASE WHEN clicked = 1 THEN (SELECT count(*) FROM imp WHERE clicked = 0) / CAST(count(*) AS DOUBLE) ELSE 1 END, 6) AS weight
FROM imp GROUP BY clicked"""))
def class_weight_ratio(spark, sf):
    return folds.class_weights(impressions(spark, sf)).select("clicked", "n", r("weight"))


@query("class_weight_balanced", """
SELECT toxic, count(*) AS n, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)), 6) AS weight FROM labels GROUP BY toxic""")
def class_weight_balanced(spark, sf):
    return folds.class_weights(table(spark, sf, "labels"), "toxic", "balanced").select("toxic", "n", r("weight"))


@query("class_weight_rows", with_imp("""
SELECT id, round(CASE WHEN clicked = 1 THEN (SELECT count(*) FILTER (WHERE clicked = 0) / CAST(count(*) FILTER (WHERE clicked = 1) AS DOUBLE) FROM imp) ELSE 1 END, 6) AS weight,
  CASE WHEN clicked = 1 THEN 51.4::DOUBLE ELSE 1.0::DOUBLE END AS fixed_weight FROM imp"""))
def class_weight_rows(spark, sf):
    rows = impressions(spark, sf).select("id", "clicked")
    weighted = folds.with_class_weight(rows, folds.class_weights(rows))
    return folds.fixed_class_weight(weighted, name="fixed_weight").select("id", r("weight"), "fixed_weight")


def _noise_sql(column: str, tag: int) -> str:
    key = f"CAST(id AS VARCHAR) || '{column}' || '{tag}'"
    u1 = f"(({hash_sql(key + chr(32) + '|| ' + chr(39) + 'u' + chr(39))} + 1) / 4294967297.0::DOUBLE)"
    u2 = f"(({hash_sql(key + chr(32) + '|| ' + chr(39) + 'v' + chr(39))} + 1) / 4294967297.0::DOUBLE)"
    return f"sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"


@query("noise_inject", with_imp(f"""
SELECT id, round(value + 1e-5 * {_noise_sql('value', 45)}, 8) AS value,
  round(CAST(l_feat_14 AS DOUBLE) + 1e-5 * {_noise_sql('l_feat_14', 45)}, 8) AS l_feat_14 FROM imp"""))
def noise_inject(spark, sf):
    """Noise of fold 3 on two numeric columns."""
    df = folds.inject_noise(impressions(spark, sf), ["value", "l_feat_14"], fold=3)
    return df.select("id", r("value", 8), r("l_feat_14", 8))
