"""Properties that hold for any input, and skewed inputs against brute force."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import attention, encode, ensemble, folds, metrics, ranking
from clickloom.plans.config import DEFAULT, unwrap
from clickloom.plans.features import FREQUENCY
from clickloom.sources import artefacts, cache, impressions, tables


def brute_ap(rows):
    """Average precision by definition over (label, score)."""
    total = sum(y for y, _ in rows)
    out, seen, hits = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        block = [y for y, t in rows if t == s]
        seen += len(block)
        hits += sum(block)
        out += sum(block) / total * hits / seen
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one score, one user and one category."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append((i, 1 if rng.random() < 0.2 else 0, 0.25 if hot else rng.random() / 1000, "hot" if hot else f"k{i % 50}"))
    return spark.createDataFrame(rows, "id int, clicked int, pred double, c string").repartition(7).cache()


@pytest.mark.parametrize("bands", [1, 3, 16])
def test_average_precision_does_not_depend_on_bands(skewed, bands):
    rows = [(r.clicked, r.pred) for r in skewed.select("clicked", "pred").collect()]
    got = metrics.average_precision(skewed, bands=bands).first().ap
    assert got == pytest.approx(brute_ap(rows), abs=1e-12)


def test_perfect_and_one_class(spark):
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "clicked int, pred double")
    assert metrics.competition_score(perfect).first().ap == pytest.approx(1.0)
    negatives = spark.createDataFrame([(0, 0.0), (0, 0.5)], "clicked int, pred double")
    row = metrics.competition_score(negatives).first()
    assert row.ap == 0.0
    assert row.wll == pytest.approx(0.5 * (np.log(2) / 2), abs=1e-9)
    assert metrics.weighted_logloss(negatives).first().wll == pytest.approx(row.wll)


def test_certain_but_wrong_is_bounded(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "clicked int, pred double")
    assert metrics.weighted_logloss(df).first().wll == pytest.approx(-np.log(1e-15), rel=1e-2)


def test_dense_index_is_text_order(skewed):
    found = skewed.select("c").distinct()
    got = {r.c: r.n for r in ranking.dense_index(found, ["c"], "n", bands=5).collect()}
    assert got == {c: i for i, c in enumerate(sorted(got))}


@pytest.mark.parametrize("prefix", [1, 3])
def test_stratified_folds(skewed, prefix):
    got = folds.stratified_folds(skewed, prefix=prefix).collect()
    assert len({r.id for r in got}) == len(got) == 3000
    for label in (0, 1):
        sizes = [sum(1 for r in got if r.clicked == label and r.fold == k) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    again = folds.stratified_folds(skewed.repartition(3), prefix=2).collect()
    assert {(r.id, r.fold) for r in got} == {(r.id, r.fold) for r in again}


def test_cut_folds(skewed):
    cuts = folds.fold_cuts(skewed, prefix=1)
    assert len(cuts) == 8
    got = folds.assign_folds(skewed, cuts).collect()
    for label in (0, 1):
        sizes = [sum(1 for r in got if r.clicked == label and r.fold == k) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1
    assert sorted(folds.fold_cuts(skewed, prefix=3)) == sorted(cuts)


def test_noise_is_fixed_and_normal(skewed):
    a = folds.inject_noise(skewed.withColumn("x", F.lit(0.0)), ["x"], fold=1, sigma=1.0).select("id", "x")
    b = folds.inject_noise(skewed.repartition(2).withColumn("x", F.lit(0.0)), ["x"], fold=1, sigma=1.0).select("id", "x")
    assert sorted(a.collect()) == sorted(b.collect())
    mean, sd = a.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean) < 0.06 and abs(sd - 1) < 0.05


def test_class_weights(skewed):
    w = {r.clicked: (r.n, r.weight) for r in folds.class_weights(skewed).collect()}
    assert w[1][1] == pytest.approx(w[0][0] / w[1][0]) and w[0][1] == 1.0
    b = {r.clicked: r.weight * r.n for r in folds.class_weights(skewed, mode="balanced").collect()}
    assert b[0] == pytest.approx(1500) and b[1] == pytest.approx(1500)


def test_frequency_of_a_hot_value(skewed):
    got = encode.freq_encode(skewed, ["c"]).where("c = 'hot'").select("c_freq").distinct().collect()
    assert [r[0] for r in got] == [pytest.approx(1 / 3)]


def test_attention_forms_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(6, 4))
    vectors = spark.createDataFrame([(str(i + 1), i + 1, [float(x) for x in v]) for i, v in enumerate(vecs)], "item string, idx int, vec array<double>")
    rows = [(1, "1,2,2,9", 3), (2, "4", 4), (3, "9,9", 1), (4, None, 2), (5, "1,2,9", 8), (6, "", None)]
    df = spark.createDataFrame(rows, "id int, seq string, candidate int")
    joined = {r.id: r.pooled for r in attention.attention_pool_join(df, vectors).collect()}
    lookup = encode.lookup_function(vectors)
    code = lookup(F.col("candidate").cast("string"))[0]
    coded = df.select("id", lookup(F.col("seq")).alias("codes"), code.alias("candidate_code"))
    whole = {r.id: r.pooled for r in attention.attention_pool(coded, vectors).collect()}
    beyond = {r.id: r.pooled for r in attention.attention_pool(coded, vectors, limit=0).collect()}

    def expected(history, c):
        m = np.array([vecs[int(x) - 1] if x != "9" else np.zeros(4) for x in history])
        s = np.array([(v @ vecs[c - 1] if c <= 6 else 0.0) if x != "9" else -1e4 for x, v in zip(history, m)])
        w = np.exp(s - s.max())
        return (w / w.sum()) @ m

    for form in (joined, whole, beyond):
        assert set(form) == {1, 2, 3, 4, 5, 6}
        for i, seq, c in (rows[0], rows[1], rows[4]):
            np.testing.assert_allclose(form[i], expected(seq.split(","), c), atol=1e-9)
        assert form[3] == form[4] == form[6] == [0.0] * 4
    bare = spark.createDataFrame([(1, None, 1), (2, [], 2), (3, [4], 4)], "id int, codes array<int>, candidate_code int")
    pooled = {r.id: r.pooled for r in attention.attention_pool(bare, vectors).collect()}
    assert pooled[1] == pooled[2] == [0.0] * 4
    np.testing.assert_allclose(pooled[3], vecs[3])


def test_blend_weights():
    leaves = ensemble.leaf_weights(ensemble.HIERARCHY)
    assert sum(leaves.values()) == pytest.approx(1.0)
    assert leaves["crossed_late"] == pytest.approx(0.3) and leaves["sequence"] == pytest.approx(0.25)
    assert leaves["tree_a"] == pytest.approx(1 / 15)
    with pytest.warns(UserWarning):
        assert ensemble.normalise({"a": 1.0, "b": 1.0}) == {"a": 0.5, "b": 0.5}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        ensemble.normalise({"a": 0.5, "b": 0.5})


def test_blend_of_one_file_is_the_file(skewed):
    one = skewed.select("id", F.col("pred").alias("clicked"))
    got = ensemble.weighted_blend({"a": one}, {"a": 1.0})
    assert sorted(got.collect()) == sorted(one.collect())


def test_repeated_ids(spark):
    a = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.5)], "id int, clicked double")
    b = spark.createDataFrame([(1, 0.6), (2, 0.7), (3, 0.1)], "id int, clicked double")
    both = {"a": a, "b": b}
    chained = ensemble.chained_blend(both, {"a": 0.5, "b": 0.5}).collect()
    assert sorted((r.id, round(r.clicked, 6)) for r in chained) == [(1, 0.4), (1, 0.5), (2, 0.6)]
    with pytest.raises(Exception, match="repeated key"):
        ensemble.weighted_blend(both, {"a": 0.5, "b": 0.5}).collect()


@pytest.mark.parametrize("values, expected", [([3.0, 1.0, 2.0], 2.0), ([1.0, None, 4.0], 2.5), ([None, None, None], None)])
def test_median_of_columns(spark, values, expected):
    df = spark.createDataFrame([tuple(values)], "a double, b double, c double")
    assert df.select(ensemble.median_of(["a", "b", "c"])).first()[0] == expected


def test_settings_wrapped_in_value():
    wrapped = {name: {"value": section} for name, section in DEFAULT.items()}
    assert unwrap(wrapped) == DEFAULT == unwrap(DEFAULT)


def test_feature_cache(spark, tmp_path):
    source = f"{tmp_path}/in.parquet"
    spark.range(5).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source).withColumn("x", F.col("id") * 2)

    root = f"{tmp_path}/cache"
    first = cache.feature_cache(spark, build, DEFAULT, [source], root).collect()
    second = cache.feature_cache(spark, build, DEFAULT, [source], root).collect()
    assert sorted(first) == sorted(second) and len(calls) == 1
    cache.feature_cache(spark, build, DEFAULT, [source], root, force=True)
    assert len(calls) == 2
    other = {**DEFAULT, "feature_engineering": {"enabled": False}}
    assert cache.cache_key(other) != cache.cache_key(DEFAULT)
    spark.range(9).write.mode("append").parquet(source)
    assert cache.feature_cache(spark, build, DEFAULT, [source], root).count() == 14
    assert len(calls) == 3


def test_missing_inputs_stop_early(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.require(spark, [f"{tmp_path}/absent.csv"])
    spark.range(2).write.parquet(f"{tmp_path}/t.parquet")
    with pytest.raises(KeyError):
        tables.key_scan(spark, f"{tmp_path}/t.parquet", "ID")


def test_runs_table(spark, tmp_path):
    root = str(tmp_path)
    for path in ("m1", "m2"):
        artefacts.record_run(spark, root, "trees", path)
    assert artefacts.latest(spark.read.parquet(f"{root}/runs")).first().path == "m2"


def test_history_of_a_hot_user_against_brute_force(spark, tmp_path):
    """One user holds a third of the events; histories are longer than the kept number of items."""
    import datetime as dt

    rng = random.Random(5)
    rows = []
    for i in range(900):
        user = 1 if i % 3 == 0 else rng.randrange(2, 40)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 6))
        rows.append((i, ts, user, rng.choice(["click", "view", "error"]), float(i % 10), f'{{"k": {rng.randrange(100)}}}'))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    ev = impressions.events(spark, str(tmp_path))
    keep = 20
    got = {(r.user_id, r.day): r.seq for r in impressions.day_sequences(ev, keep).collect()}
    events = sorted((u, ts, i, p.split(": ")[1].rstrip("}")) for i, ts, u, _, _, p in rows)
    for (user, day), seq in got.items():
        earlier = [k for u, ts, _, k in events if u == user and ts.date() < day]
        assert (seq or "") == ",".join(earlier[-keep:])
    for r in impressions.day_sequences(ev).collect():
        assert (r.seq or "") == ",".join(k for u, ts, _, k in events if u == r.user_id and ts.date() < r.day)
    rates = {(r.user_id, r.day): r.history_a_1 for r in impressions.day_history(ev).collect()}
    for (user, day), rate in rates.items():
        past = [kind for _, ts, u, kind, _, _ in rows if u == user and ts.date() < day]
        assert rate == (past.count("click") / (past.count("error") + 1) if past else None)


def test_frequency_columns_are_the_documented_ones():
    assert FREQUENCY == ("inventory_id", "age_group", "gender")


def test_whole_plan_queries_show_every_added_column(spark):
    from clickloom.plans import features
    from clickloom.plans.queries import whole_plans as w
    from clickloom.sources.impressions import impressions

    rows = impressions(spark, "/root/testdata/sf0.001", *w.ALL, "seq")
    for plan, shown in ((features.tree_features, w.TREE), (features.deep_features, w.DEEP), (features.two_stage_features, w.TWO_STAGE)):
        assert set(plan(rows).columns) - set(rows.columns) <= set(shown)
