"""Learners beat a constant, folds do not leak, stored models score the same."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import ensemble, folds, learners, metrics
from clickloom.plans import training
from clickloom.sources import artefacts


@pytest.fixture(scope="module")
def data(spark):
    from clickloom.functions.hashing import keyed_hash32

    u = [(keyed_hash32("id", t) % 1000) / F.lit(1000.0) for t in "xyz"]
    df = spark.range(1500).select("id", u[0].alias("x"), u[1].alias("y"), (keyed_hash32("id", "c") % 3).cast("string").alias("cat"), u[2].alias("z"))
    df = df.withColumn("clicked", (F.col("x") * F.col("y") + F.col("z") * 0.3 > 0.5).cast("int")).drop("z")
    return training.with_folds(df).cache()


def wll(df):
    return metrics.weighted_logloss(df).first().wll


def test_boosted_trees_beat_a_constant(data, tmp_path):
    weighted = folds.with_class_weight(data, folds.class_weights(data, mode="balanced"))
    model = learners.tree_pipeline(["x", "y"], ["cat"], "b", "weight", maxIter=5, maxDepth=3).fit(weighted.where("fold != 1"))
    scored = learners.score(model, data.where("fold = 1"), keep=("clicked",))
    assert wll(scored) < wll(scored.withColumn("pred", F.lit(0.5)))
    path = artefacts.save_model(model, str(tmp_path), "b", 1)
    again = learners.score(artefacts.load_fold_models({1: path})[1], data.where("fold = 1"), keep=("clicked",))
    assert sorted(again.collect()) == sorted(scored.collect())


def test_set_ups_keep_their_parameters(spark):
    a = learners.boosted_trees("a", "w")
    assert (a.getMaxDepth(), a.getStepSize(), a.getMaxIter(), a.getSubsamplingRate()) == (10, 0.01, 2500, 0.8)
    assert learners.boosted_trees("b").getMaxDepth() == 6 and learners.boosted_trees("c").getMaxIter() == 4000


def test_cross_validation_scores_every_row_once(data):
    models, oof, scores = training.cross_validate(data, {"linear": learners.crossed_linear(["x", "y"], maxIter=10)})
    assert oof.count() == 1500 and oof.select("id").distinct().count() == 1500
    by_fold = {r.fold: r for r in scores.collect()}
    assert set(by_fold) == {0, 1, 2, 3, 4, 5}
    assert by_fold[0].ap > 0.6
    held = oof.where("fold = 2").select("id", "pred").collect()
    direct = learners.score(models["linear"][2], data.where("fold = 2")).collect()
    assert sorted(held) == sorted(direct)


def test_fold_rows_weigh_by_training_rows_and_move_only_those(data):
    made = training.fold_rows(["x"], "balanced")(data, 2)
    both = made.join(data.select("id", F.col("x").alias("raw")), "id")
    assert both.where("fold = 2 AND x != raw").count() == 0 and both.where("fold != 2 AND x = raw").count() == 0
    counts = {r.clicked: r["count"] for r in data.where("fold != 2").groupBy("clicked").count().collect()}
    weights = {r.clicked: r.weight for r in made.select("clicked", "weight").distinct().collect()}
    assert weights == {c: pytest.approx(sum(counts.values()) / (2 * n)) for c, n in counts.items()}


def test_blend_and_stack(data):
    estimators = {
        "linear": learners.crossed_linear(["x", "y"], maxIter=10),
        "plain": learners.crossed_linear(["x"], degree=1, maxIter=10),
    }
    models, oof, _ = training.cross_validate(data, estimators, folds=5)
    weights = ensemble.perf_weights(metrics.competition_score(oof, by=["model"]))
    w = {r.model: r.w for r in weights.collect()}
    assert sum(w.values()) == pytest.approx(1.0) and w["linear"] > w["plain"]
    blended = training.score_and_blend(data, models, weights)
    assert blended.count() == 1500
    assert blended.where("clicked < 0 or clicked > 1").count() == 0
    long = learners.fold_score(data, models["linear"], "linear").unionByName(learners.fold_score(data, models["plain"], "plain"))
    assert long.count() == 1500 * 10
    stacked = learners.stack(oof, ensemble.fold_mean(long), ["linear", "plain"])
    assert stacked.count() == 1500 and stacked.where("clicked < 0 or clicked > 1").count() == 0


def test_early_stopping_uses_the_marked_rows(data):
    est = learners.tree_pipeline(["x", "y"], [], "b", validation="is_validation", maxIter=3, maxDepth=2)
    models = learners.fit_folds(data, est, folds=2, validation="is_validation")
    assert set(models) == {1, 2}


def test_columns_of_many_values_are_set_apart(data):
    rows = data.withColumn("many", F.col("id").cast("string"))
    assert learners.by_cardinality(rows, ["cat", "many"]) == (["cat"], ["many"])


def test_a_learner_without_inputs_left_out(data):
    from clickloom.plans.queries import learning

    rows = data.withColumn("cat_idx", F.col("cat").cast("double")).drop("cat")
    assert learning.inputs_of(rows) == (["x", "y"], ["cat_idx"])
    only = rows.withColumn("clicked", (F.col("cat_idx") == 1).cast("int"))
    seen, held = only.where("fold != 1"), only.where("fold = 1")
    model, facts = learning._linear(learning.crossed(seen, seen, "clicked"))
    assert wll(learners.score(model, learning.crossed(seen, held, "id", "clicked"), keep=("clicked",))) < 0.35 and facts["loss"] < facts["constant"]


def test_the_factor_machine_learns_beyond_the_smallest_tables(spark):
    from clickloom.plans.queries import REGISTRY
    from compare import compare, oracle

    sf = "/root/testdata/sf0.01"
    assert compare(oracle(sf), REGISTRY["factor_machine"], spark, sf) is None
