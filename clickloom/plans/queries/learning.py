"""Learner queries.

SQL cannot fit models, so it shows what it can know: which rows are scored, how often and in which fold, that every prediction is a probability, and
that each model learned something: its weighted loss on its training rows is below that of the prediction it starts from (the rate of the weighted classes, a half, for set-ups A and B and the
rate of the class for the others; a half for set-up C as well, whose weights favour one class). The models themselves are checked by tests.

The set-ups train with their published rounds, depth and patience, on five folds, and are cut at their best round. Feature tables, fold models and out-of-fold rows
are stored under a key of settings and inputs; what is there already, from another query or an earlier run, is not made again.
"""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...functions.values import sigmoid
from ...operators import boosting, crosses, encode, ensemble, folds, learners, linear, metrics
from ...session import cut_lineage, shared_dir, side_by_side
from ...sources import artefacts, cache, tables
from ...sources.impressions import impressions, is_train, table, tied_predictions
from .. import features, training
from ..config import DEFAULT
from .registry import TIED, query, r, with_imp
from .storage import fresh

#: Categories with clearly fewer values enter as indices, others frequency encoded.
NATIVE_VALUES = 64
LEAKS = ("event_type", "value", "ts", "user_id", "seq")
PLANS = {"tree": features.tree_features, "two_stage": features.two_stage_features}
#: Columns as they come, not derived from others: their pairs are crossed.
RAW = re.compile(r"(l_feat|feat_[a-e]|history_[ab])_[0-9]+")
LINEAR = {"regParam": 0.01, "maxIter": 100}


#: What SQL knows of the rows of the later days, and of out-of-fold rows.
LATER = with_imp("SELECT id, clicked, true AS in_range, true AS learned FROM imp WHERE day >= DATE '2024-01-25'")
LATER_IDS = with_imp("SELECT id, true AS in_range, true AS learned FROM imp WHERE day >= DATE '2024-01-25'")
LATER_FOLDS = with_imp("""
SELECT id, 'linear' AS model, CAST(fold AS INTEGER) AS fold, true AS in_range, true AS learned
FROM (SELECT id, unnest(range(1, 6)) AS fold FROM imp WHERE day >= DATE '2024-01-25') x""")
OUT_OF_FOLD = with_imp("""
SELECT unnest(['b', 'linear']) AS model, id, clicked,
  CAST(ntile(5) OVER (PARTITION BY clicked ORDER BY md5(CAST(id AS VARCHAR) || '42') || CAST(id AS VARCHAR)) AS INTEGER) AS fold, true AS in_range
FROM imp WHERE day < DATE '2024-01-25'""")


def _inputs(sf):
    return [f"{sf}/{t}.parquet" for t in ("events", "customer", "orders")]


def _settings(plan: str) -> dict:
    return {**DEFAULT, "features": {"plan": plan, "cuts": "training rows", "native": NATIVE_VALUES}}


def stored_features(spark, sf, plan: str = "tree"):
    """Training rows with folds, and later rows, of a feature plan: computed once and kept under their key.

    Numbers come filled and as doubles, categories as indices (``<column>_idx``) that are the same for all folds.
    """
    settings = _settings(plan)
    k, seed = settings["training"]["n_folds"], settings["training"]["seed"]

    def build():
        source = impressions(spark, sf, "users", "orders", "history", "seq")
        rows = source.transform(PLANS[plan]).drop(*LEAKS)
        text = [c for c, t in rows.dtypes if t == "string"]
        rows = cut_lineage(learners.filled(rows, [c for c, t in rows.dtypes if t not in ("string", "date") and c not in ("id", "clicked")], text))
        few, many = learners.by_cardinality(rows, text, NATIVE_VALUES)
        if many:
            rows = encode.freq_encode(rows, many).drop(*many)
        for indexer in learners.native_categories(few):
            rows = indexer.fit(rows.where(is_train())).transform(rows).drop(*few)
        cuts = folds.fold_cuts(source.where(is_train()).select("id", "clicked"), k=k, seed=seed)
        return folds.assign_folds(rows, cuts, k=k, seed=seed)

    df = cache.feature_cache(spark, build, settings, _inputs(sf), f"{shared_dir(spark)}/clickloom/features", partition_by=["fold"])
    return df.where(is_train()), df.where(~is_train())


def model_root(spark, sf, plan: str) -> str:
    """Where the models of a feature plan and its settings are kept."""
    learner = {"boosted": boosting.SETUPS, "plain": boosting.PLAIN, "weighting": learners.CLASS_WEIGHTING, "linear": LINEAR, "rows": boosting.ROWS}
    key = cache.cache_key({**_settings(plan), "training": {**DEFAULT["training"], **learner}}, [cache.input_stamp(spark, p) for p in _inputs(sf)])
    return f"{shared_dir(spark)}/clickloom/learners-{key}"


def inputs_of(df):
    """All numbers and all category indices of a feature table."""
    indices = [c for c in df.columns if c.endswith("_idx")]
    return [c for c, t in df.dtypes if t not in ("string", "date") and c not in ("id", "clicked", "fold", "weight", *indices)], indices


def _plan(setup: str) -> str:
    return "two_stage" if setup == "c" else "tree"


def stored_bins(spark, sf, plan: str, bins: int):
    """<id, clicked, fold, train, bins> of all rows of a feature plan, and the cuts; stored under their key."""
    train, test = stored_features(spark, sf, plan)
    numeric, indices = inputs_of(train)
    root = model_root(spark, sf, plan)
    path = f"{root}/cuts-{bins}"
    if not tables.exists(spark, f"{path}/_SUCCESS"):
        cuts = boosting.quantile_cuts(train, numeric, bins)
        spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "place int, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(path)
    cuts = [r.cuts for r in spark.read.parquet(path).orderBy("place").collect()]
    return numeric, indices, cuts, train, test


def boosted_runs(spark, sf, setup: str):
    """The run rows of the five fold models of a set-up, trained to their best rounds if they are not there yet."""
    p = boosting.settings(setup)
    numeric, indices, cuts, train, _ = stored_bins(spark, sf, _plan(setup), p["bins"])
    sample = training.labelled_sample(train, boosting.ROWS)

    def fit(k: int, path: str) -> dict:
        # the class weights of set-up A are its learner's own and do not weigh what it watches; set-up C has no noise
        weighed = training.fold_rows((), learners.CLASS_WEIGHTING[setup])(sample, k)
        rows = boosting.binned(weighed, numeric, indices, cuts, ("id", "clicked", "weight", "fold"), noise=None if setup == "c" else k)
        boosting.train(rows, setup, len(numeric), k).write.mode("overwrite").parquet(path)
        best = spark.read.parquet(path).where("best").first()
        return {"rounds": best["round"] + 1, "held_loss": best.held, "loss": best.loss, "constant": boosting.START_LOSS}

    return training.train_folds(spark, model_root(spark, sf, _plan(setup)), setup, fit)


def boosted_scores(spark, sf, setup: str, runs, later: bool, keep, own=None):
    """Rows of the later days (or of the training days) scored by the fold models of a set-up."""
    numeric, indices, cuts, train, test = stored_bins(spark, sf, _plan(setup), boosting.settings(setup)["bins"])
    rows = boosting.binned(test if later else train, numeric, indices, cuts, keep)
    models = {k: boosting.to_best(spark.read.parquet(run.path)) for k, run in sorted(runs.items())}
    return boosting.scored(rows, models, len(numeric), keep, own)


def crossed(train, rows, *keep):
    """<keep..., features>: the crossed inputs, scaled by the training rows."""
    numeric, indices = inputs_of(train)
    return crosses.crossed_vectors(rows, crosses.scale_of(train, numeric), indices, [c for c in numeric if RAW.fullmatch(c)], keep)


def _linear(rows):
    """MLlib's own fit over crossed vectors, which it keeps: for small tables."""
    model = LogisticRegression(featuresCol="features", labelCol="clicked", **LINEAR).fit(rows)
    history = model.summary.objectiveHistory
    return model, {"rounds": model.summary.totalIterations, "loss": history[-1], "constant": history[0]}


def linear_models(spark, sf, folds):
    """<model, facts> of the crossed linear model for each fold, without its rows (None: of all rows). Rows are packed and stored once; their crosses are made anew in each pass and kept nowhere."""
    train, _ = stored_features(spark, sf)
    numeric, indices = inputs_of(train)
    inputs = linear.Inputs(crosses.scale_of(train, numeric), indices, [c for c in numeric if RAW.fullmatch(c)])
    path = f"{model_root(spark, sf, 'tree')}/packed"
    if not tables.exists(spark, f"{path}/_SUCCESS"):
        linear.packed(train, inputs).write.mode("overwrite").option("compression", "none").parquet(path)
    made = linear.fit_logistic(spark.read.parquet(path), inputs, folds, LINEAR["regParam"], LINEAR["maxIter"])
    return {k: (linear.logistic_model(spark, w, b), {"rounds": len(history) - 1, "loss": float(history[-1]), "constant": float(history[0])}) for k, (w, b, history) in made.items()}


def linear_runs(spark, sf):
    """The run rows of the crossed linear model's folds, all fitted in the same passes."""

    def fit(missing: list) -> dict:
        save = lambda model: lambda path: PipelineModel(stages=[model]).write().overwrite().save(path)
        return {k: (save(model), facts) for k, (model, facts) in linear_models(spark, sf, missing).items()}

    return training.train_folds_at_once(spark, model_root(spark, sf, "tree"), "linear", fit)


def _models(runs):
    return artefacts.load_fold_models({k: run.path for k, run in runs.items()})


def _learned(*runs) -> bool:
    return all(run.loss < run.constant for each in runs for run in each.values())


def _shown(scored, learned: bool, *keep, pred="pred"):
    return scored.select("id", *keep, F.col(pred).between(0, 1).alias("in_range"), F.lit(learned).alias("learned"))


def _boosted(spark, sf, setup: str):
    """The later rows, scored by the five fold models side by side, with the median of the folds."""
    runs = boosted_runs(spark, sf, setup)
    wide = boosted_scores(spark, sf, setup, runs, True, ("id", "clicked"))
    median = ensemble.median_of([f"pred_{k}" for k in runs])
    return _shown(wide.select("id", "clicked", median.alias("pred")), _learned(runs), "clicked")


@query("boosted_trees_a", LATER)
def boosted_trees_a(spark, sf):
    """Set-up A, weighted by the class ratio."""
    return _boosted(spark, sf, "a")


@query("boosted_trees_b", LATER)
def boosted_trees_b(spark, sf):
    """Set-up B, balanced classes."""
    return _boosted(spark, sf, "b")


@query("boosted_trees_c", LATER)
def boosted_trees_c(spark, sf):
    """Set-up C on the two-stage features, fixed class weights, watched by the area under the curve."""
    return _boosted(spark, sf, "c")


@query("boosted_rounds")
def boosted_rounds(spark, sf):
    """The rounds that each fold of set-up B was cut at, with its losses."""
    runs = boosted_runs(spark, sf, "b")
    rows = [("b", k, int(run.rounds), run.held_loss, run.loss, run.constant) for k, run in sorted(runs.items())]
    return spark.createDataFrame(rows, "model string, fold int, rounds int, held_loss double, loss double, constant double")


@query("full_fit_holdout", with_imp("""
SELECT count(*) AS n_rows, CAST(sum(clicked) AS BIGINT) AS clicks, count(*) AS in_range, true AS measured
FROM imp WHERE day >= DATE '2024-01-25'"""))
def full_fit_holdout(spark, sf):
    """One model of set-up B on all training rows, with the mean of the folds' rounds, stored, loaded again, scored and measured."""
    runs = boosted_runs(spark, sf, "b")
    rounds = max(1, round(sum(run.rounds for run in runs.values()) / len(runs)))
    numeric, indices, cuts, train, test = stored_bins(spark, sf, "tree", boosting.settings("b")["bins"])
    sample = training.labelled_sample(train, boosting.ROWS)
    weighted = folds.with_class_weight(sample, folds.class_weights(sample, mode="balanced"))
    trees = boosting.train(boosting.binned(weighted, numeric, indices, cuts, ("id", "clicked", "weight", "fold")), "b", len(numeric), None, rounds=rounds)
    trees = artefacts.save_table(trees, fresh(spark, "models"), "b_full")
    later = boosting.binned(test, numeric, indices, cuts, ("id", "clicked"))
    rows = cut_lineage(boosting.scored(later, {0: trees}, len(numeric), ("id", "clicked")).withColumnRenamed("pred_0", "pred"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("clicked").alias("clicks"), F.count_if(F.col("pred").between(0, 1)).alias("in_range")
    )
    measured = metrics.competition_score(rows).select((F.col("ap").between(0, 1) & (F.col("wll") > 0)).alias("measured"))
    return counts.withColumn("_one", F.lit(1)).join(measured.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("crossed_linear", LATER)
def crossed_linear(spark, sf):
    """Explicit second-order crosses in a sparse vector, and logistic regression."""
    train, test = stored_features(spark, sf)
    model, facts = linear_models(spark, sf, [None])[None]
    scored = learners.score(model, crossed(train, test, "id", "clicked"), keep=("clicked",))
    return _shown(scored, facts["loss"] < facts["constant"], "clicked")


@query("factor_machine", LATER)
def factor_machine(spark, sf):
    """Second-order crosses through factor vectors, on standardised numbers and hashed categories; steps as MLlib's, over packed rows."""
    train, test = stored_features(spark, sf)
    numeric, indices = inputs_of(train)
    scale = crosses.scale_of(train, numeric)
    inputs = lambda df, *keep: crosses.crossed_vectors(df, scale, indices, (), keep, buckets=1 << 12)
    places = linear.Inputs(scale, indices, (), buckets=1 << 12)
    path = f"{fresh(spark, 'factors')}/packed"
    linear.packed(train, places).write.option("compression", "none").parquet(path)
    made = linear.fit_factors(spark.read.parquet(path), places, learners.FACTORED["stepSize"], learners.FACTORED["regParam"], folds.SEED)
    model, rows = linear.factor_model(spark, *made), inputs(train, "clicked")
    right = F.when(F.col("clicked") == 1, F.col("pred")).otherwise(1 - F.col("pred"))
    loss = learners.positive_probability(model.transform(rows)).agg(F.avg(-F.log(F.greatest(right, F.lit(metrics.EPS))))).first()[0]
    learned = loss < boosting.class_rate_loss(train)
    return _shown(learners.score(model, inputs(test, "id", "clicked"), keep=("clicked",)), learned, "clicked")


def _cross_validated(spark, sf):
    """Runs, out-of-fold rows and later predictions by fold of set-up B and the crossed linear model; models and out-of-fold rows are stored."""
    train, test = stored_features(spark, sf)
    runs = dict(zip(("b", "linear"), side_by_side(spark, lambda f: f(), [lambda: boosted_runs(spark, sf, "b"), lambda: linear_runs(spark, sf)])))
    models = _models(runs["linear"])
    path = f"{model_root(spark, sf, 'tree')}/out_of_fold"
    if not tables.exists(spark, f"{path}/_SUCCESS"):
        trees = boosted_scores(spark, sf, "b", runs["b"], False, ("id", "clicked", "fold"), own="fold").withColumn("model", F.lit("b"))
        linear = learners.out_of_fold(crossed(train, train, "id", "clicked", "fold"), models, "linear")
        trees.unionByName(linear).write.mode("overwrite").parquet(path)
    wide = {
        "b": boosted_scores(spark, sf, "b", runs["b"], True, ("id",)),
        "linear": learners.fold_score_wide(crossed(train, test, "id"), models),
    }
    return runs, spark.read.parquet(path), wide


@query("oof_frame", OUT_OF_FOLD)
def oof_frame(spark, sf):
    """Out-of-fold predictions of two learners over five folds."""
    _, oof, _ = _cross_validated(spark, sf)
    return oof.select("model", "id", "clicked", F.col("fold").cast("int").alias("fold"), F.col("pred").between(0, 1).alias("in_range"))


@query("cv_scores", """
SELECT model, CAST(fold AS INTEGER) AS fold, true AS measured, true AS learned
FROM (SELECT unnest(['b', 'linear']) AS model) m, (SELECT unnest(range(0, 6)) AS fold) f""")
def cv_scores(spark, sf):
    """The scores of each fold of the cross-validated learners, and of all rows as fold 0."""
    runs, oof, _ = _cross_validated(spark, sf)
    scores = metrics.fold_metrics(oof)
    measured = (F.col("ap").between(0, 1) & (F.col("wll") > 0)).alias("measured")
    return scores.select("model", F.col("fold").cast("int").alias("fold"), measured, F.lit(_learned(*runs.values())).alias("learned"))


@query("fold_score", LATER_FOLDS)
def fold_score(spark, sf):
    """Every later row scored by each fold model of one learner."""
    train, test = stored_features(spark, sf)
    runs = linear_runs(spark, sf)
    scored = learners.fold_score(crossed(train, test, "id"), _models(runs), "linear")
    return _shown(scored, _learned(runs), "model", "fold")


@query("train_score_blend", LATER_IDS)
def train_score_blend(spark, sf):
    """Five folds of two learners, performance weights kept as a table, fold medians and the blend of later days."""
    runs, oof, wide = _cross_validated(spark, sf)
    weights = ensemble.perf_weights(metrics.competition_score(oof, by=["model"]))
    weights = artefacts.save_table(weights, fresh(spark, "weights"), "blend")
    return _shown(training.blend_folds(wide, weights), _learned(*runs.values()), pred="clicked")


@query("stacking", LATER_IDS)
def stacking(spark, sf):
    """Logistic regression over the out-of-fold columns, applied to the later days."""
    runs, oof, wide = _cross_validated(spark, sf)
    later = training.joined_folds(wide, how="mean")
    return _shown(learners.stack(oof, later, list(wide)), _learned(*runs.values()), pred="clicked")


@query("area_under_curve", f"""WITH {TIED},
runs AS (SELECT s, count(*) AS n, sum(y) AS tp FROM tied GROUP BY s),
cum AS (SELECT s, tp, n - tp AS fp, sum(tp) OVER (ORDER BY s DESC) AS cum_tp FROM runs)
SELECT round(sum(fp * (cum_tp - tp / 2.0::DOUBLE)) / (sum(tp) * sum(fp)), 9) AS auc FROM cum""")
def area_under_curve(spark, sf):
    """The area under the ROC curve of scores with many ties."""
    return metrics.area_under_curve(tied_predictions(spark, sf), "y", "s").select(r("auc", 9))


@query("sigmoid", """
SELECT event_id AS id, round(1 / (1 + exp(-(value - 20) / 10)), 6) AS p FROM events""")
def sigmoid_query(spark, sf):
    score = (F.col("value") - 20) / 10
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), r(sigmoid(score), alias="p"))


@query("poly_cross", """
SELECT l_orderkey, l_linenumber, CAST(9 AS INTEGER) AS width,
  round(x + y + z + x * x + y * y + z * z + x * y + x * z + y * z, 4) AS total
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_discount AS y, l_tax AS z FROM lineitem) t""")
def poly_cross(spark, sf):
    """All first- and second-order products of three columns."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z")
    )
    crossed = PolynomialExpansion(degree=2, inputCol="raw", outputCol="features").transform(
        learners.assembler(["x", "y", "z"], "raw").transform(rows)
    )
    parts = vector_to_array("features")
    return crossed.select(
        "l_orderkey",
        "l_linenumber",
        F.size(parts).alias("width"),
        r(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), 4, "total"),
    )
