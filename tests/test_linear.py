"""Models fitted over crosses that are made anew in every pass, against MLlib's fits over kept vectors."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from clickloom.operators import crosses, linear
from clickloom.plans import training
from clickloom.sources import artefacts

SCALE = {"x": (0.5, 0.3), "y": (0.4, 0.2), "z": (0.0, 1.0)}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).selectExpr("id", "cast(id * 37 % 101 as double) / 100 as x", "case when id % 11 = 0 then null else cast(id * 53 % 89 as double) / 100 end as y", "1.0D as z", "id % 3 as c", "cast(id * 7 % 5 as string) as d")
    return training.with_folds(df.withColumn("clicked", ((F.col("x") * F.coalesce("y", F.lit(0.4)) > 0.2) & (F.col("c") != 1) | (F.col("id") % 13 == 0)).cast("int"))).cache()


@pytest.mark.parametrize("buckets", [13, 1 << 12])
def test_models_of_all_folds_are_those_of_mllib(spark, rows, buckets):
    inputs = linear.Inputs(SCALE, ["c", "d"], ["x", "y"], buckets)
    made = linear.fit_logistic(linear.packed(rows, inputs).cache(), inputs, [None, 2, 4], 0.01)
    for k, (coefficients, intercept, values) in made.items():
        seen = rows if k is None else rows.where(F.col("fold") != k)
        vectors = crosses.crossed_vectors(seen, SCALE, ["c", "d"], ["x", "y"], ("clicked",), buckets)
        wanted = LogisticRegression(featuresCol="features", labelCol="clicked", regParam=0.01, maxIter=100).fit(vectors)
        history = wanted.summary.objectiveHistory
        assert values[0] == pytest.approx(history[0], rel=1e-9) and values[-1] == pytest.approx(history[-1], rel=1e-5)
        model = linear.logistic_model(spark, coefficients, intercept)
        both = [[r.probability[1] for r in m.transform(vectors).select("probability").collect()] for m in (wanted, model)]
        assert np.abs(np.subtract(*both)).max() < 0.005


def test_rows_without_label_or_fold_and_one_class(spark, rows):
    inputs = linear.Inputs(SCALE, [], ["x"], 7)
    some = rows.withColumn("fold", F.when(F.col("id") % 4 > 0, F.col("fold"))).withColumn("clicked", F.when(F.col("id") % 5 > 0, F.col("clicked")))
    blocks = linear.packed(some, inputs).cache()
    labelled = some.where("clicked IS NOT NULL")
    n = linear.moments(blocks, inputs, [0, 3])[0]
    assert n.tolist() == [labelled.where("fold IS NOT NULL AND fold != 3").count(), labelled.where("fold IS NULL").count(), labelled.where("fold = 3").count()]
    (coefficients, intercept, values), = linear.fit_logistic(linear.packed(rows.where("clicked = 1"), inputs), inputs, [None], 0.01).values()
    assert intercept == float("inf") and not coefficients.any() and values == [0.0]


def test_folds_fitted_together_go_on_where_they_stopped(spark, tmp_path):
    asked = []

    def fit(missing):
        asked.append(missing)
        return {k: (lambda path: None, {"loss": k}) for k in missing if k != 3 or len(asked) > 1}

    assert set(training.train_folds_at_once(spark, f"{tmp_path}", "m", fit)) == {1, 2, 4, 5}
    runs = training.train_folds_at_once(spark, f"{tmp_path}", "m", fit)
    assert asked == [[1, 2, 3, 4, 5], [3]] and runs[3].loss == 3.0 and runs[3].path == f"{tmp_path}/models/m_fold3"
    assert training.train_folds_at_once(spark, f"{tmp_path}", "m", None) == runs == artefacts.fold_runs(spark, f"{tmp_path}", "m")


def test_the_linear_queries_keep_no_crossed_rows(spark):
    from clickloom.plans.queries import REGISTRY, learning

    sizes = []
    fit = LogisticRegression.fit
    LogisticRegression.fit = lambda self, df, *a: sizes.append(df) or fit(self, df, *a)
    try:
        assert REGISTRY["crossed_linear"].run(spark, "/root/testdata/sf0.001").where("NOT in_range OR NOT learned").count() == 0
        learning.linear_runs(spark, "/root/testdata/sf0.001")
    finally:
        LogisticRegression.fit = fit
    assert not sizes


@pytest.mark.parametrize("buckets", [5, 64])
def test_factors_are_those_of_mllib(spark, rows, buckets):
    from clickloom.operators import learners

    inputs = linear.Inputs(SCALE, ["c", "d"], (), buckets)
    factors, coefficients, intercept = linear.fit_factors(linear.packed(rows, inputs).cache(), inputs, 0.01, 1e-5, learners.SEED, rounds=12)
    vectors = crosses.crossed_vectors(rows, SCALE, ["c", "d"], (), ("clicked",), buckets).cache()
    wanted = learners.factor_learner(stepSize=0.01, maxIter=12).fit(vectors)
    assert np.abs(wanted.factors.toArray() - factors).max() < 1e-9 and np.abs(wanted.linear.toArray() - coefficients).max() < 1e-9 and wanted.intercept == pytest.approx(intercept, abs=1e-9)
    model = linear.factor_model(spark, factors, coefficients, intercept)
    both = [[r.probability[1] for r in m.transform(vectors).select("probability").collect()] for m in (wanted, model)]
    assert np.abs(np.subtract(*both)).max() < 1e-9
