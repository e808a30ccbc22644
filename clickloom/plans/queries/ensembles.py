"""Blending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import ensemble, metrics
from ...sources.impressions import PREDICTION_MODELS, fold_predictions, model_predictions
from .metrics import FOLD_METRICS
from .registry import MODELS, query, r


def _tables(spark, sf):
    return {m: model_predictions(spark, sf, m) for m in PREDICTION_MODELS}


def _blend_sql(wa: str, wb: str, wc: str) -> str:
    return f"""WITH {MODELS}
SELECT a.id, round({wa} * a.clicked + {wb} * b.clicked + {wc} * c.clicked, 8) AS clicked
FROM sub_a a JOIN sub_b b ON a.id = b.id JOIN sub_c c ON a.id = c.id"""


@query("weighted_blend", _blend_sql("0.5::DOUBLE", "0.3::DOUBLE", "0.2::DOUBLE"))
def weighted_blend(spark, sf):
    return ensemble.weighted_blend(_tables(spark, sf), {"a": 0.5, "b": 0.3, "c": 0.2}).select("id", r("clicked", 8))


@query("weighted_blend_rescaled", _blend_sql("(0.5 / 1.1::DOUBLE)", "(0.4 / 1.1::DOUBLE)", "(0.2 / 1.1::DOUBLE)"))
def weighted_blend_rescaled(spark, sf):
    """Weights that sum to 1.1 are rescaled, with a warning."""
    return ensemble.weighted_blend(_tables(spark, sf), {"a": 0.5, "b": 0.4, "c": 0.2}).select("id", r("clicked", 8))


@query("equal_blend", _blend_sql("0.5::DOUBLE", "0.5::DOUBLE", "0.0::DOUBLE"))
def equal_blend(spark, sf):
    tables = {m: t for m, t in _tables(spark, sf).items() if m != "c"}
    return ensemble.weighted_blend(tables, {"a": 0.5, "b": 0.5}).select("id", r("clicked", 8))


@query("simple_average", _blend_sql("(1 / 3.0::DOUBLE)", "(1 / 3.0::DOUBLE)", "(1 / 3.0::DOUBLE)"))
def simple_average(spark, sf):
    """0.33 each, rescaled."""
    return ensemble.weighted_blend(_tables(spark, sf), {m: 0.33 for m in PREDICTION_MODELS}).select("id", r("clicked", 8))


@query("inner_blend", f"""WITH {MODELS}
SELECT a.id, round(0.6 * a.clicked + 0.4 * b.clicked, 8) AS clicked FROM sub_a a JOIN sub_b b ON a.id = b.id
WHERE a.id % 3 <> 0 AND b.id % 5 <> 0""")
def inner_blend(spark, sf):
    """Rows missing from any file are dropped."""
    tables = _tables(spark, sf)
    parts = {"a": tables["a"].where(F.col("id") % 3 != 0), "b": tables["b"].where(F.col("id") % 5 != 0)}
    return ensemble.weighted_blend(parts, {"a": 0.6, "b": 0.4}).select("id", r("clicked", 8))


WEIGHTS = f"""{FOLD_METRICS},
pw AS (SELECT model, score / (SELECT sum(score) FROM fm WHERE fold = 0) AS w FROM fm WHERE fold = 0)"""


def _weights(spark, sf):
    """Scores over the whole out-of-fold vector, not the mean of fold scores."""
    scores = metrics.competition_score(fold_predictions(spark, sf), by=["model"])
    return ensemble.perf_weights(scores)


@query("perf_weights", f"""WITH {WEIGHTS} SELECT model, round(w, 6) AS w FROM pw""")
def perf_weights(spark, sf):
    return _weights(spark, sf).select("model", r("w"))


@query("perf_blend", f"""WITH {WEIGHTS},
med AS (SELECT id, model, median(pred) AS pred FROM preds GROUP BY id, model)
SELECT id, round(sum(w * pred), 8) AS clicked FROM med JOIN pw USING (model) GROUP BY id""")
def perf_blend(spark, sf):
    """Median over folds per model, then the performance weights."""
    predictions = ensemble.fold_median(fold_predictions(spark, sf), folds=range(1, 6))
    return ensemble.blend_long(predictions, _weights(spark, sf)).select("id", r("clicked", 8))


LEAVES = {"tree_a": "a", "tree_b": "b", "tree_c": "c", "sequence": "a", "crossed_early": "b", "crossed_late": "c"}


@query("hierarchical_blend", f"""WITH {MODELS}
SELECT a.id, round((1.0 / 5) * (a.clicked / 3 + b.clicked / 3 + c.clicked / 3)
  + (2.5 / 5) * (a.clicked / 2 + b.clicked / 2) + (1.5 / 5) * c.clicked, 8) AS clicked
FROM sub_a a JOIN sub_b b ON a.id = b.id JOIN sub_c c ON a.id = c.id""")
def hierarchical_blend(spark, sf):
    """The documented two-level blend; three stand-in models fill its six places."""
    tables = _tables(spark, sf)
    weights = ensemble.leaf_weights(ensemble.HIERARCHY)
    return ensemble.weighted_blend({n: tables[LEAVES[n]] for n in weights}, weights).select("id", r("clicked", 8))
