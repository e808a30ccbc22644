"""Boosted trees, sparse crosses and resumable folds against plain computations."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import boosting, crosses, folds, metrics
from clickloom.plans import training
from clickloom.sources import artefacts


def problem(n=1000, seed=3):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 12, (n, 6)).astype(np.uint8)
    signal = (bins[:, 0] > 5).astype(float) + (bins[:, 1] > 8) * (bins[:, 2] < 4)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * signal))).astype(float)
    return bins, y, rng


@pytest.mark.parametrize("setup", ["a", "b", "c"])
def test_leaves_are_worth_what_a_hand_computation_gives(setup):
    bins, y, rng = problem()
    p = boosting.settings(setup, rows=1.0)
    w = np.where(y == 1, 3.0, 1.0)
    g, h = w * (0.5 - y), w * 0.25
    feature, cut, child, value, at = boosting.grow(bins, g, h, p, rng)
    assert (boosting.reached(bins, feature, cut, child) == at).all() and child[0] == 1
    for leaf in np.unique(at):
        gs, hs = g[at == leaf].sum(), h[at == leaf].sum()
        expected = -math.copysign(max(abs(gs) - p["l1"], 0), gs) / (hs + p["l2"])
        expected = min(max(expected, -p["step"]), p["step"]) if p["step"] else expected
        assert value[leaf] == pytest.approx(expected * p["rate"], abs=1e-12) and hs >= p["child"]
    depth = {0: 0}
    for node in np.flatnonzero(child):
        depth[child[node]] = depth[child[node] + 1] = depth[node] + 1
    assert max(depth.values()) <= p["depth"]
    if p["symmetric"]:
        for level in set(depth.values()):
            assert len({(feature[k], cut[k]) for k, d in depth.items() if d == level and child[k]}) <= 1


def test_the_first_cut_is_the_best_of_all():
    bins, y, rng = problem(400)
    g, h = 0.5 - y, np.full(len(y), 0.25)
    feature, cut, *_ = boosting.grow(bins, g, h, boosting.settings({"depth": 1, "rate": 1.0, "rounds": 1, "l2": 2.0}), rng)

    def gain(f, b):
        low = bins[:, f] <= b
        return sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (low, ~low))

    assert gain(feature[0], cut[0]) == pytest.approx(max(gain(f, b) for f in range(6) for b in range(11)))


@pytest.mark.parametrize("watch", ["loss", "weighted loss", "auc"])
def test_training_stops_after_patience_and_learns(watch):
    bins, y, _ = problem(1500)
    seen = np.arange(len(y)) % 5 != 0
    w = np.where(y == 1, 2.0, 1.0)
    p = boosting.settings("b", watch=watch, patience=15, rounds=400, rate=0.2)
    made = list(boosting.boost(bins, y, w, seen, p))
    held = [m[4] for m in made]
    best = int(np.argmin(held))
    assert len(made) == best + 16 < 400
    assert made[-1][5] < made[0][5] < boosting.START_LOSS and held[best] < (-0.6 if watch == "auc" else 0.69)
    longer = list(boosting.boost(bins, y, w, seen, {**p, "patience": 10_000, "rounds": best + 40}))
    assert [m[4] for m in longer][: len(held)] == held


def test_areas_under_the_curve_agree(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(int(a), float(b), "x") for a, b in zip(y, s)] + [(1, 0.5, "one"), (1, None, "x"), (None, 0.1, "x")], "clicked int, pred double, part string")
    assert boosting.area(y, s) == pytest.approx(brute)
    assert {r.part: r.auc for r in metrics.area_under_curve(df, by=["part"]).collect()} == {"x": pytest.approx(brute), "one": None}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(1200).selectExpr("id", "cast(id * 37 % 101 as double) / 10 as x", "cast(id * 53 % 17 as double) as z", "cast(id % 5 as double) as c_idx")
    rows = rows.withColumn("clicked", ((F.col("x") > 5) & (F.col("c_idx") != 2)).cast("int")).withColumn("weight", F.lit(1.0))
    return training.with_folds(rows).cache()


def test_fold_models_score_as_they_were_trained(spark, table, tmp_path):
    cuts = boosting.quantile_cuts(table, ["x", "z"], 32)
    assert all(c == sorted(c) and len(c) < 32 for c in cuts)
    models = {}
    for k in (1, 2):
        rows = boosting.binned(table, ["x", "z"], ["c_idx"], cuts, ("id", "clicked", "weight", "fold"), noise=k)
        boosting.train(rows, "b", 2, k, rounds=30, rate=0.3).write.parquet(f"{tmp_path}/{k}")
        models[k] = boosting.to_best(spark.read.parquet(f"{tmp_path}/{k}"))
        best = spark.read.parquet(f"{tmp_path}/{k}").where("best").first()
        assert models[k].count() == best["round"] + 1
    bins = boosting.binned(table, ["x", "z"], ["c_idx"], cuts, ("id", "clicked", "fold"))
    wide = {r.id: r for r in boosting.scored(bins, models, 2, ("id", "clicked", "fold")).collect()}
    raw = {r.id: np.frombuffer(r.bins, np.uint8) for r in bins.collect()}
    for k, model in models.items():
        ranks, trees = boosting.loaded(model)
        for i in (0, 7, 900):
            b, margin = raw[i].copy(), 0.0
            b[2] = ranks[0][b[2]]
            for feature, cut, child, value in trees:
                node = 0
                while child[node]:
                    node = child[node] + int(b[feature[node]] > cut[node])
                margin += value[node]
            assert wide[i][f"pred_{k}"] == pytest.approx(1 / (1 + math.exp(-margin)))
        held = [r for r in wide.values() if r.fold == k]
        assert np.mean([(r[f"pred_{k}"] > 0.5) == (r.clicked == 1) for r in held]) > 0.95
    own = {r.id: r.pred for r in boosting.scored(bins.where("fold < 3"), models, 2, ("id",), own="fold").collect()}
    assert all(own[i] == wide[i][f"pred_{wide[i].fold}"] for i in own)


def test_noise_is_fixed_and_only_on_training_rows(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "NOISE_SIGMA", 3.0)
    cuts = boosting.quantile_cuts(table, ["x"], 64)
    plain = {r.id: (r.fold, r.bins) for r in boosting.binned(table, ["x"], [], cuts, ("id", "fold")).collect()}
    noisy = {r.id: r.bins for r in boosting.binned(table.repartition(5), ["x"], [], cuts, ("id", "fold"), noise=2).collect()}
    assert all((noisy[i] == b) for i, (f, b) in plain.items() if f == 2)
    assert sum(noisy[i] != b for i, (f, b) in plain.items() if f != 2) > 500
    assert noisy == {r.id: r.bins for r in boosting.binned(table, ["x"], [], cuts, ("id", "fold"), noise=2).collect()}
    draws = folds.normal_draws(np.arange(20000), 3)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1) < 0.02 and abs(np.corrcoef(draws.T)[0, 1]) < 0.03


def test_folds_go_on_where_they_stopped(spark, tmp_path):
    root, made = f"{tmp_path}/runs", []

    def fit(k, path):
        made.append(k)
        if k == 3 and made.count(3) == 1:
            raise RuntimeError("lost")
        return {"rounds": k}

    with pytest.raises(RuntimeError):
        training.train_folds(spark, root, "m", fit)
    before = set(artefacts.fold_runs(spark, root, "m"))
    assert 3 not in before
    runs = training.train_folds(spark, root, "m", fit)
    assert set(runs) == {1, 2, 3, 4, 5} and runs[4].rounds == 4.0 and runs[2].path == f"{root}/models/m_fold2"
    assert all(made.count(k) == 1 for k in before)
    assert training.train_folds(spark, root, "m", None) == runs
    assert artefacts.fold_runs(spark, root, "other") == {}


def test_sample_is_bounded_and_fixed(spark):
    rows = spark.range(20000)
    some = training.labelled_sample(rows, 5000)
    assert 4700 < some.count() < 5300 and some.exceptAll(training.labelled_sample(rows.repartition(3), 5000)).count() == 0
    assert training.labelled_sample(rows, 20000).count() == 20000


def test_crosses_against_a_dictionary():
    rng = np.random.default_rng(5)
    numbers, codes = np.round(rng.normal(size=(40, 4)), 1), rng.integers(0, 2**63, (40, 3)).astype(np.uint64)
    for buckets in (7, 1 << 20):
        bounds, places, values, size = crosses.entries(numbers, codes, [0, 2, 3], buckets)
        assert size == 4 + 3 + buckets
        for i in range(40):
            expected = {k: v for k, v in enumerate(numbers[i])}
            expected |= {4 + k: numbers[i, a] * numbers[i, b] for k, (a, b) in enumerate(combinations([0, 2, 3], 2))}

            def put(a, b, v):
                place = 7 + int(crosses._bucket(np.array([a], np.uint64), np.array([b], np.uint64), buckets)[0])
                expected[place] = expected.get(place, 0.0) + v

            for c in range(3):
                put(codes[i, c], 1, 1.0)
                for n in (0, 2, 3):
                    put(codes[i, c], n + 2, numbers[i, n])
            for a, b in combinations(range(3), 2):
                put(codes[i, a], codes[i, b], 1.0)
            got = dict(zip(places[bounds[i] : bounds[i + 1]].tolist(), values[bounds[i] : bounds[i + 1]].tolist()))
            assert list(got) == sorted(got) and got == pytest.approx({k: v for k, v in expected.items() if abs(v) > 1e-12}, abs=1e-9)


def test_crossed_vectors_take_nulls_as_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, float("nan"), "a"), (4, 3.0, "b")], "id long, x double, c string")
    got = {r.id: r.features for r in crosses.crossed_vectors(df, {"x": (2.0, 1.0)}, ["c"], keep=("id",)).collect()}
    assert got[1][0] == -1.0 and got[4][0] == 1.0 and got[2][0] == got[3][0] == 0.0
    assert got[1].numNonzeros() == 3 and got[3].numNonzeros() == 1 and set(got[3].indices) < set(got[1].indices)
    assert crosses.crossed_vectors(df.where("id > 9"), {"x": (2.0, 1.0)}, ["c"]).count() == 0


def test_parts_are_computed_once_for_each_file(spark, tmp_path):
    from clickloom.sources import cache

    path, root, seen = f"{tmp_path}/in put", f"{tmp_path}/kept", []

    def build(rows):
        seen.append(rows.count())
        return rows.select(cache.PART, "id", (F.col("id") * 2).alias("twice"))

    def features():
        return sorted(tuple(r) for r in cache.part_cache(spark, build, {"features": {"v": 1}}, path, root).collect())

    spark.range(10).coalesce(1).write.parquet(path)
    assert features() == [(i, 2 * i) for i in range(10)] and features() == [(i, 2 * i) for i in range(10)] and seen == [10]
    spark.range(10, 13).coalesce(1).write.mode("append").parquet(path)
    assert features() == [(i, 2 * i) for i in range(13)] and seen == [10, 3]
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(path)
    assert features() == [(i, 2 * i) for i in range(5)] and seen == [10, 3, 5]
    cache.part_cache(spark, build, {"features": {"v": 2}}, path, root)
    assert seen == [10, 3, 5, 5]


def plain_level(bins, g, h, p):
    """The best first cut by plain sums over every column and bin, the first of equal ones."""
    soft = lambda v: math.copysign(max(abs(v) - p["l1"], 0.0), v)
    worth = lambda s: soft(g[s].sum()) ** 2 / (h[s].sum() + p["l2"])
    found = [(worth(low) + worth(~low), -f, -b) for f in range(bins.shape[1]) for b in range(int(bins[:, f].max())) for low in [bins[:, f] <= b] if min(h[low].sum(), h[~low].sum()) >= p["child"]]
    return max(found, key=lambda x: (round(x[0], 9), x[1], x[2]))


def test_columns_of_few_bins_cost_few_cells(monkeypatch):
    rng = np.random.default_rng(8)
    y = (rng.random(4000) < 0.4).astype(float)
    bins = np.concatenate([rng.integers(0, 2, (4000, 10)), rng.integers(0, 256, (4000, 1)), np.zeros((4000, 3))], axis=1).astype(np.uint8)
    p = boosting.settings("a", rows=1.0, columns=1.0, level_columns=1.0, depth=6)
    cells, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w=None, n=0, **k: cells.append(n) or count(x, w, n or k.get("minlength", 0)))
    feature, cut, child, value, at = boosting.grow(bins, 0.5 - y, np.full(4000, 0.25), p, rng)
    monkeypatch.undo()
    assert len(np.unique(at)) > 8 and (boosting.reached(bins, feature, cut, child) == at).all()
    # 10 columns of 2 bins and one of 256, not 14 of 256
    assert sum(cells) < 4 * 64 * 2 * (256 + 20)
    best = plain_level(bins, 0.5 - y, np.full(4000, 0.25), p)
    assert (feature[0], cut[0]) == (-best[1], -best[2])
