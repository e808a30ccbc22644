"""Histories as counts against histories as lists."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickloom.operators import attention, encode, folds, histories


@pytest.fixture(scope="module")
def clicks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(9), rng.randrange(50), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows.append((900, 77, 5, 1, "a"))
    rows.append((901, None, 5, 1, "a"))
    df = spark.createDataFrame(rows, "id long, user_id long, day int, ts int, item string")
    return rows, df.repartition(4)


def before(rows, user, day):
    return [r[4] for r in sorted((r for r in rows if r[1] == user and r[2] < day and r[4] is not None), key=lambda r: (r[2], r[3], r[0]))]


def test_candidate_match_against_lists(clicks):
    rows, df = clicks
    asked = df.select("id", "user_id", "day", F.when(F.col("id") % 7 == 0, "zz").otherwise(F.col("item")).alias("candidate"))
    asked = asked.unionByName(asked.sparkSession.createDataFrame([(1000, 1, 100, "a"), (1001, 55, 3, "a"), (1002, 2, 0, "b"), (1003, 1, 4, None)], asked.schema))
    got = {r.id: tuple(r)[1:] for r in histories.candidate_match(asked, df).collect()}
    wanted = {}
    for r in asked.collect():
        past = before(rows, r.user_id, r.day) if r.user_id is not None else []
        n = past.count(r.candidate) if r.candidate is not None else 0
        wanted[r.id] = (int(n > 0), n, past[::-1].index(r.candidate) + 1 if n else 0)
    assert got == wanted
    assert histories.candidate_match(asked.where("id < 0"), df).count() == 0


def test_bags_against_lists(clicks):
    rows, df = clicks
    got = defaultdict(dict)
    for r in histories.bags(df).collect():
        assert r.item not in got[r.user_id, r.day]
        got[r.user_id, r.day][r.item] = r.times
    for user, day in {(r[1], r[2]) for r in rows if r[1] is not None}:
        assert got.get((user, day), {}) == Counter(before(rows, user, day))
    last = {u: max(r[2] for r in rows if r[1] == u) for u in (1, 2, 3, 77)}
    assert {r.item for r in histories.history_items(df).collect()} == {r[4] for r in rows if r[1] in last and r[2] < last[r[1]] and r[4]}


def test_counted_attention_equals_attention_over_lists(spark, clicks):
    rows, df = clicks
    df = df.where("user_id IS NOT NULL AND id < 60")
    kept = [r for r in rows if r[1] is not None and r[0] < 60]
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.5]), ("b", 2, [0.2, -1.0]), ("c", 3, [0.0, 2.0])], "item string, idx int, vec array<double>")
    code = F.coalesce("idx", F.lit(0))
    held = histories.item_arrays(histories.bags(df).join(vectors.select("item", "idx"), "item", "left"), code)
    asked = df.join(vectors.select("item", "idx"), "item", "left").select("id", "user_id", "day", code.alias("candidate_code"))
    counted = asked.join(held, ["user_id", "day"], "left")
    listed = spark.createDataFrame([(r[0], [{"a": 1, "b": 2, "c": 3}.get(x, 0) for x in before(kept, r[1], r[2])], {"a": 1, "b": 2, "c": 3}.get(r[4], 0)) for r in kept], "id long, codes array<int>, candidate_code int")
    expected = {r.id: r.pooled for r in attention.attention_pool(listed, vectors).collect()}
    for limit in (attention.MATRIX_BYTES, 0):
        got = {r.id: r.pooled for r in attention.attention_pool(counted, vectors, limit=limit, times="times").collect()}
        assert set(got) == set(expected) and all(got[i] == pytest.approx(expected[i], abs=1e-9) for i in got)


def joined_pools(events, vectors):
    """Pooled vectors by way of a row for each event and item of its history."""
    met = events.join(histories.bags(events).withColumnRenamed("item", "held"), ["user_id", "day"], "left")
    counted = met.select("id", F.col("item").alias("_candidate"), F.col("held").alias("item"), F.coalesce("times", F.lit(0)).alias("times"))
    return attention.pooled(attention.bag_weights(counted, vectors), vectors)


@pytest.mark.parametrize("products, pairs", [(1024, 1 << 16), (1, 50)])
def test_grouped_pools_equal_joined_ones(spark, monkeypatch, products, pairs):
    monkeypatch.setattr(attention, "PRODUCT_ITEMS", products)
    monkeypatch.setattr(attention, "PAIRS_AT_ONCE", pairs)
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(9)]), rng.choice(["a", "b", "c", "d", "e", None])) for i in range(300)]
    twice = [*rows, (5, 2, 7, "a"), (5, 2, 7, "a"), (None, 1, 3, "b"), (None, 3, 8, "d"), (9, None, None, None), (900, 77, 1, "a")]
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.2, -1.0]), ("c", [0.0, 2.0]), ("e", None), (None, [4.0, 4.0])], "item string, vec array<double>")
    for data, known in ((rows, vectors), (twice, vectors), (rows, vectors.unionByName(vectors.limit(2))), ([], vectors)):
        events = spark.createDataFrame(data, "id long, user_id long, day int, item string").repartition(3)
        expected = {r.id: r.pooled for r in joined_pools(events, known).collect()}
        found = attention.pool_histories(events, known, group=40).collect()
        got = {r.id: r.pooled for r in found}
        assert len(found) == len(got) and set(got) == set(expected) and all(got[i] == pytest.approx(expected[i], abs=1e-9) for i in got)


def test_pooled_histories_shuffle_events_and_not_their_pairs(spark, tmp_path):
    rows = [(i, i % 20, i // 200, str(i % 97)) for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, user_id long, day int, item string").selectExpr(
        "event_id", "user_id", "'view' AS event_type", "timestamp_seconds(day * 86400L + event_id) AS ts", "1.0D AS value", "concat('{\"k\": ', item, '}') AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(97).selectExpr("id AS vec_id", "transform(sequence(1, 8), x -> cast(sin(x * id) AS float)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    from clickloom.plans.queries import REGISTRY

    made = REGISTRY["attention_pool_join"].run(spark, str(tmp_path))
    assert made.count() == 6000 * 8
    rest, sent = [made._jdf.queryExecution().executedPlan()], 0
    made.collect()
    while rest:
        node = rest.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            rest.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.metrics().contains("shuffleRecordsWritten"):
            sent += node.metrics().apply("shuffleRecordsWritten").value()
        rest += [node.children().apply(k) for k in range(node.children().size())]
    assert 6000 <= sent < 6000 + 97 * 60


def test_joined_encoding_keeps_rows_that_share_a_key(spark):
    rows = [(1, "x,y"), (1, "y"), (1, "y"), (2, None), (2, ""), (2, None)]
    vocabulary = spark.createDataFrame([("x", 1), ("y", 2)], "item string, idx int")
    got = sorted((r.id, r.codes) for r in encode.seq_encode_join(spark.createDataFrame(rows, "id long, seq string"), vocabulary).collect())
    assert got == [(1, [1, 2]), (1, [2]), (1, [2]), (2, [0]), (2, [0]), (2, [0])]


def test_rows_without_a_label_are_in_no_fold(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, (F.col("id") % 3 == 0).cast("int")).alias("clicked"))
    got = {r.clicked: {} for r in rows.distinct().collect()}
    for r in folds.assign_folds(rows, folds.fold_cuts(rows)).groupBy("clicked", "fold").count().collect():
        got[r.clicked][r.fold] = r["count"]
    assert got[None] == {None: 250} and all(max(v.values()) - min(v.values()) <= 1 and len(v) == 5 for c, v in got.items() if c is not None)


def test_ordered_statistics_are_running_means(spark):
    import hashlib

    from clickloom.operators import targets

    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 6 + ["x", "y", None]), rng.choice([0, 1, 1, None]), rng.choice([1, 2, 3])) for i in range(600)] + [(700, "new", None, 2), (701, "only held", 1, 2)]
    df = spark.createDataFrame(rows, "id long, c string, clicked int, fold int").repartition(5)
    counted = [r for r in rows if r[2] is not None and r[3] != 2]
    prior = sum(r[2] for r in counted) / len(counted)
    order = lambda r: hashlib.md5(f"{r[0]}42".encode()).hexdigest() + str(r[0])
    wanted = {}
    for r in rows:
        past = [o for o in counted if o[1] == r[1] and (r not in counted or order(o) < order(r))]
        wanted[r[0]] = (sum(o[2] for o in past) + 10 * prior) / (len(past) + 10)
    for prefix in (1, 3, None):
        got = {r.id: r.c_target for r in targets.fold_statistics(df, ["c"], 2, prefix=prefix).collect()}
        assert got == {i: pytest.approx(v, abs=1e-12) for i, v in wanted.items()}
    assert targets.ordered_statistics(df.where("id < 0"), ["c"]).count() == 0
