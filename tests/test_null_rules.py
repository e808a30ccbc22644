"""Nulls, NaN and missing parts: one rule on every path."""

import math

import pytest

from clickloom.operators import encode, ensemble, folds, metrics
from clickloom.operators.learners import boosted_trees


def test_empty_item_in_the_vocabulary(spark):
    rows = [(1, "1,,2"), (2, None), (3, ""), (4, "9"), (5, "2"), (5, "1")]
    df = spark.createDataFrame(rows, "id long, seq string")
    vocabulary = spark.createDataFrame([("", 1), ("1", 2), ("2", 3)], "item string, idx int")
    expected = [(1, [2, 1, 3]), (2, [0]), (3, [0]), (4, [0]), (5, [2]), (5, [3])]
    for limit in (1 << 20, 0):
        assert sorted((r.id, r.codes) for r in encode.seq_encode(df, vocabulary, limit=limit).collect()) == expected
    with pytest.raises(ValueError):
        encode.lookup_function(vocabulary, limit=0)


def test_logloss_leaves_out_unscored_rows(spark):
    good = [(1, 0.9), (0, 0.2), (1, 0.6)]
    odd = good + [(1, None), (0, float("nan")), (None, 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "clicked int, pred double")
    expected = 0.5 * -math.log(0.8) + 0.5 * -(math.log(0.9) + math.log(0.6)) / 2
    for rows in (good, odd):
        assert metrics.weighted_logloss(frame(rows)).first().wll == pytest.approx(expected)


def test_null_prediction_makes_a_null_blend(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None)], "id long, clicked double")
    b = spark.createDataFrame([(1, 0.1), (2, 0.1)], "id long, clicked double")
    got = dict(ensemble.weighted_blend({"a": a, "b": b}, {"a": 0.5, "b": 0.5}).collect())
    assert got[1] == pytest.approx(0.3) and got[2] is None


def test_long_blend_needs_every_model(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.1), (2, "a", 0.5), (3, "a", 0.5), (3, "b", None), (1, "other", 9.0)]
    predictions = spark.createDataFrame(rows, "id long, model string, pred double")
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "model string, w double")
    got = ensemble.blend_long(predictions, weights)
    assert [(r.id, round(r.clicked, 6)) for r in got.collect()] == [(1, 0.34)]
    assert "hashpartitioning(model" not in got._jdf.queryExecution().toString()


def test_class_weight_keeps_null_labels(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "clicked int")
    got = folds.with_class_weight(df, folds.class_weights(df.where("clicked is not null")))
    assert sorted((r.clicked is None, r.clicked, r.weight) for r in got.where("clicked is not null").collect()) == [(False, 0, 1.0), (False, 0, 1.0), (False, 1, 2.0)]
    assert got.where("clicked is null").first().weight is None


def test_early_stopping_tolerance():
    assert boosted_trees("a").getOrDefault("validationTol") == 0.0
