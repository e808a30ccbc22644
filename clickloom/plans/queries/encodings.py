"""Encoding queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...operators import encode, learners, targets
from ...sources.impressions import impressions, is_train
from .. import features
from .registry import query, r, with_imp


@query("freq_encode", with_imp("""
SELECT id, """ + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {c}) / CAST(count(*) OVER () AS DOUBLE) END, 6) AS {c}_freq"
    for c in features.FREQUENCY) + " FROM imp", "users"))
def freq_encode(spark, sf):
    df = encode.freq_encode(impressions(spark, sf, "users").select("id", *features.FREQUENCY), features.FREQUENCY)
    return df.select("id", *[r(f"{c}_freq") for c in features.FREQUENCY])


LABELS = ("gender", "age_group", "inventory_id", "l_feat_14")


@query("label_encode", with_imp("SELECT id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'UNK')) - 1 AS INTEGER) AS {c}_code" for c in LABELS)
    + " FROM imp", "users"))
def label_encode(spark, sf):
    """One code list per column, fitted on train and test together."""
    rows = impressions(spark, sf, "users").select("id", "day", *LABELS)
    codes = encode.label_table([rows.where(is_train()), rows.where(~is_train())], LABELS)
    df = encode.apply_labels(rows, codes, LABELS)
    return df.select("id", *[f"{c}_code" for c in LABELS])


@query("category_codes", with_imp("""
SELECT id, CAST(CASE WHEN inventory_id IS NULL THEN (SELECT count(DISTINCT inventory_id) FROM imp)
    ELSE (SELECT count(DISTINCT inventory_id) FROM imp i WHERE i.inventory_id < o.inventory_id) END AS INTEGER) AS inventory_id_code,
  CAST(CASE WHEN gender IS NULL THEN 2 WHEN gender = '2.0' THEN 1 ELSE 0 END AS INTEGER) AS gender_code
FROM imp o""", "users"))
def category_codes(spark, sf):
    df = impressions(spark, sf, "users").select("id", "inventory_id", "gender")
    df = encode.category_codes(df, ["inventory_id", "gender"])
    return df.select("id", "inventory_id_code", "gender_code")


@query("label_cardinality", with_imp(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'UNK')) AS classes FROM imp" for c in LABELS), "users"))
def label_cardinality(spark, sf):
    """Number of classes per categorical column, in one pass over stacked pairs."""
    rows = impressions(spark, sf, "users")
    pair = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("UNK")).alias("v")) for c in LABELS]
    )
    return rows.select(F.inline(pair)).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("classes"))


NUMERIC = ("l_feat_1", "l_feat_2", "l_feat_3", "feat_b_1")


@query("assemble", with_imp("""
SELECT id, CAST(4 + 1 AS INTEGER) AS width, round(l_feat_1 + l_feat_2 + l_feat_3 + feat_b_1 + (dense_rank() OVER (ORDER BY coalesce(inventory_id, 'UNK')) - 1), 4) AS total
FROM imp""", "users"))
def assemble(spark, sf):
    """Numeric block and one code column per category in a feature vector."""
    rows = impressions(spark, sf, "users")
    coded = encode.apply_labels(rows, encode.label_table([rows], ["inventory_id"]), ["inventory_id"])
    df = learners.assembler([*NUMERIC, "inventory_id_code"]).transform(coded)
    parts = vector_to_array("features")
    return df.select(
        "id",
        F.size(parts).alias("width"),
        r(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), 4, "total"),
    )


@query("native_categories", with_imp("SELECT id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, '__MISSING__')) - 1 AS DOUBLE) AS {c}_idx" for c in ("gender", "age_group", "inventory_id"))
    + " FROM imp", "users"))
def native_categories(spark, sf):
    """Nominal indices with metadata, as the tree learners split on them."""
    cols = ("gender", "age_group", "inventory_id")
    df = learners.filled(impressions(spark, sf, "users").select("id", *cols), (), cols)
    few, _ = learners.by_cardinality(df, cols)
    for indexer in learners.native_categories(few):
        df = indexer.fit(df).transform(df)
    return df.select("id", *[f"{c}_idx" for c in cols])


@query("target_encode", with_imp("""
SELECT id, round((n * m + 10 * g) / (n + 10), 6) AS inventory_target FROM (
  SELECT i.id, t.n, t.m, t.g FROM imp i JOIN (
    SELECT coalesce(inventory_id, '__MISSING__') AS v, count(*) AS n, avg(clicked) AS m, (SELECT avg(clicked) FROM imp) AS g
    FROM imp GROUP BY 1) t ON t.v = coalesce(i.inventory_id, '__MISSING__')) x""", "users"))
def target_encode(spark, sf):
    """Smoothed mean label per category."""
    df = learners.filled(impressions(spark, sf, "users").select("id", "clicked", "inventory_id"), (), ["inventory_id"])
    df = df.withColumn("clicked", F.col("clicked").cast("double"))
    for indexer in learners.native_categories(["inventory_id"]):
        df = indexer.fit(df).transform(df)
    df = learners.target_encoding(["inventory_id_idx"]).fit(df).transform(df)
    return df.select("id", r("inventory_id_idx_target", alias="inventory_target"))


@query("ordered_target", with_imp("""
, t AS (SELECT id, clicked, day < DATE '2024-01-25' AS seen, md5(CAST(id AS VARCHAR) || '42') || CAST(id AS VARCHAR) AS o, coalesce(inventory_id, '__MISSING__') AS inv, coalesce(gender, '__MISSING__') AS g FROM imp),
p AS (SELECT avg(clicked) AS prior FROM t WHERE seen)
SELECT id, round((CASE WHEN seen THEN coalesce(sum(clicked) FILTER (WHERE seen) OVER inv_before, 0) ELSE coalesce(sum(clicked) FILTER (WHERE seen) OVER inv_all, 0) END + 10 * prior)
    / (CASE WHEN seen THEN count(*) FILTER (WHERE seen) OVER inv_before ELSE count(*) FILTER (WHERE seen) OVER inv_all END + 10), 9) AS inventory_id_target,
  round((CASE WHEN seen THEN coalesce(sum(clicked) FILTER (WHERE seen) OVER g_before, 0) ELSE coalesce(sum(clicked) FILTER (WHERE seen) OVER g_all, 0) END + 10 * prior)
    / (CASE WHEN seen THEN count(*) FILTER (WHERE seen) OVER g_before ELSE count(*) FILTER (WHERE seen) OVER g_all END + 10), 9) AS gender_target
FROM t, p
WINDOW inv_before AS (PARTITION BY inv ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), inv_all AS (PARTITION BY inv),
  g_before AS (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g_all AS (PARTITION BY g)""", "users").replace("\n\n,", ","))
def ordered_target(spark, sf):
    """Two categories as running rates of the training rows before each row; later rows get the rate of all training rows."""
    rows = impressions(spark, sf, "users").select("id", "clicked", "day", "inventory_id", "gender")
    made = targets.ordered_statistics(rows, ["inventory_id", "gender"], seen=is_train())
    return made.select("id", r("inventory_id_target", 9), r("gender_target", 9))
