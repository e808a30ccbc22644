"""Source, sink, cache and artefact queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions import temporal
from ...operators import encode, ensemble
from ...session import configure, shared_dir
from ...sources import artefacts, cache, tables
from ...sources.impressions import PREDICTION_MODELS, impressions, model_predictions, table
from .. import features
from ..config import DEFAULT
from .projection import TWO_STAGE_SQL
from .registry import MODELS, query, r, with_imp


def fresh(spark, name: str) -> str:
    """A folder of its own for every run."""
    return f"{shared_dir(spark)}/clickloom/{name}-{uuid.uuid4().hex[:12]}"


@query("scan_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount >= 0.05::DOUBLE")
def scan_columns(spark, sf):
    """Column list and filter reach the Parquet scan."""
    lines = tables.scan(configure(spark), f"{sf}/lineitem.parquet")
    return lines.where(F.col("l_discount") >= 0.05).select("l_orderkey", "l_linenumber", "l_quantity")


@query("key_scan", "SELECT event_id AS id FROM events")
def key_scan(spark, sf):
    return tables.key_scan(spark, f"{sf}/events.parquet", "event_id")


@query("csv_round_trip", f"WITH {MODELS} SELECT id, round(clicked, 6) AS clicked FROM sub_a")
def csv_round_trip(spark, sf):
    """Written as a prediction file and read back with the given schema."""
    path = tables.write_predictions(model_predictions(spark, sf, "a"), fresh(spark, "csv"))
    return tables.read_predictions(spark, path).select("id", r("clicked"))


@query("csv_inferred", f"WITH {MODELS} SELECT CAST(id AS BIGINT) AS id, round(clicked, 6) AS clicked FROM sub_b")
def csv_inferred(spark, sf):
    path = tables.write_predictions(model_predictions(spark, sf, "b"), fresh(spark, "csv"), ordered=True)
    return tables.read_csv_inferred(spark, path).select(F.col("id").cast("bigint").alias("id"), r("clicked"))


@query("blend_files", f"""WITH {MODELS}
SELECT a.id, round(0.5::DOUBLE * a.clicked + 0.3::DOUBLE * b.clicked + 0.2::DOUBLE * c.clicked, 8) AS clicked
FROM sub_a a JOIN sub_b b ON a.id = b.id JOIN sub_c c ON a.id = c.id""")
def blend_files(spark, sf):
    """Prediction files in, one blended file out, with the existence check first."""
    paths = {
        m: tables.write_predictions(model_predictions(spark, sf, m), fresh(spark, f"sub_{m}")) for m in PREDICTION_MODELS
    }
    tables.require(spark, paths.values())
    blended = ensemble.weighted_blend(
        {m: tables.read_predictions(spark, p) for m, p in paths.items()}, {"a": 0.5, "b": 0.3, "c": 0.2}
    )
    out = tables.write_predictions(blended, fresh(spark, "blend"), ordered=True)
    return tables.read_predictions(spark, out).select("id", r("clicked", 8))


@query("model_outputs", f"""WITH {MODELS}
SELECT 'a' AS model, count(*) AS n_rows, round(avg(clicked), 6) AS mean FROM sub_a
UNION ALL SELECT 'b', count(*), round(avg(clicked), 6) FROM sub_b
UNION ALL SELECT 'c', count(*), round(avg(clicked), 6) FROM sub_c""")
def model_outputs(spark, sf):
    """One output per model from one write of the long table."""
    long = None
    for m in PREDICTION_MODELS:
        part = model_predictions(spark, sf, m).withColumn("model", F.lit(m))
        long = part if long is None else long.unionByName(part)
    folder = fresh(spark, "outputs")
    tables.write_model_outputs(long, folder, list(PREDICTION_MODELS))
    stored = spark.read.schema("id bigint, clicked double, model string").option("header", True).csv(folder)
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("clicked"), alias="mean"))


@query("feature_cache", TWO_STAGE_SQL)
def feature_cache(spark, sf):
    """Two-stage features written under their key, then served from the stored table."""
    inputs = [f"{sf}/{t}.parquet" for t in ("events", "customer", "orders")]

    def build():
        return features.two_stage_features(impressions(spark, sf, "users", "orders", "history"))

    root = fresh(spark, "cache")
    cache.feature_cache(spark, build, DEFAULT, inputs, root)
    df = cache.feature_cache(spark, build, DEFAULT, inputs, root)
    return df.select(
        "id", "gender", "day_hour_cross", "is_weekend", "hour_period", "inv_gender_cross", r("inventory_id_freq"),
        r("hist_a_delta_13"), "history_a_trend", r("feat_c_sum", 2), F.col("history_b_max").cast("double").alias("history_b_max"),
    )


@query("artefact_tables", with_imp("""
SELECT id, CAST(dense_rank() OVER (ORDER BY coalesce(inventory_id, 'UNK')) - 1 AS INTEGER) AS inventory_id_code FROM imp""", "users"))
def artefact_tables(spark, sf):
    """An encoder stored as a table, loaded and applied as a scoring job would."""
    rows = impressions(spark, sf, "users").select("id", "inventory_id")
    stored = artefacts.save_table(encode.label_table([rows], ["inventory_id"]), fresh(spark, "encoders"), "labels")
    return encode.apply_labels(rows, stored, ["inventory_id"]).select("id", "inventory_id_code")


@query("latest_artefact", """
SELECT o_custkey AS name, 'run_' || CAST(o_orderkey AS VARCHAR) AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'run_' || CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders) x
WHERE rn = 1""")
def latest_artefact(spark, sf):
    """Orders stand for runs: the newest path per name, without sorting the runs."""
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("name"),
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").alias("created_at"),
    )
    return artefacts.latest(runs)


@query("feature_parts", """
SELECT event_id AS id, CAST(hour(ts) IN (2, 3, 4) AS TINYINT) AS is_dawn, CAST(isodow(ts) = 2 AS TINYINT) AS is_tuesday, CAST(isodow(ts) IN (6, 7) AS TINYINT) AS is_weekend FROM events""")
def feature_parts(spark, sf):
    """Row-local features kept for each file of the input, read by a second run."""
    def build(rows):
        hour, day = F.hour("ts"), F.weekday("ts") + 1
        flags = {"is_dawn": temporal.is_dawn(hour), "is_tuesday": temporal.is_tuesday(day), "is_weekend": temporal.is_weekend(day, "sat_sun")}
        return rows.select(cache.PART, F.col("event_id").alias("id"), *[c.alias(n) for n, c in flags.items()])

    def stop(rows):
        raise AssertionError("nothing is computed twice")

    root = fresh(configure(spark), "parts")
    cache.part_cache(spark, build, DEFAULT, f"{sf}/events.parquet", root)
    return cache.part_cache(spark, stop, DEFAULT, f"{sf}/events.parquet", root)
