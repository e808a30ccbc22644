"""Edge rows that the generated tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from clickloom.functions import cross, history, horizontal, sequence, temporal, values
from clickloom.operators import encode
from clickloom.plans import features


def one(df, column, order="id"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


@pytest.fixture(scope="module")
def seqs(spark):
    rows = [(1, None), (2, ""), (3, "74"), (4, "1,74,2"), (5, "74,1"), (6, ",".join(["9"] * 100)), (7, ",".join(["9"] * 101)),
            (8, ",".join(["9"] * 200)), (9, ",".join(["9"] * 1001)), (10, "x,2.5,,3")]
    return spark.createDataFrame(rows, "id int, seq string")


def test_length_of_null_and_empty(seqs):
    assert one(seqs, sequence.length())[:4] == [None, 1, 1, 3]
    assert one(seqs, sequence.length(null_length=0))[:2] == [0, 1]


def test_length_bin_at_the_edges(seqs):
    bins = one(seqs, sequence.length_bin(sequence.length()))
    assert bins[0] == 4 and bins[1] == 0
    assert bins[5:9] == [0, 1, 1, 4]


def test_has_item_inner_and_boundary(seqs):
    assert one(seqs, sequence.has_item("seq", "74"))[:5] == [None, 0, 0, 1, 0]
    assert one(seqs, sequence.has_item("seq", "74", boundary=True))[:5] == [None, 0, 1, 1, 1]


def test_truncation_head_and_tail(seqs):
    assert one(seqs, sequence.truncated("seq", 2))[:5] == [None, "", "74", "1,74", "74,1"]
    assert one(seqs, sequence.truncated("seq", 1, "tail"))[3] == "2"


def test_numeric_items(seqs):
    got = one(seqs, sequence.numeric("seq"))
    assert got[0] == [0.0] and got[1] == [0.0]
    assert got[9] == [None, 2.5, None, 3.0]


def test_unique_count_of_null_is_zero(seqs):
    assert one(seqs, sequence.unique_count())[:3] == [0, 1, 1]


def test_candidate(spark):
    df = spark.createDataFrame([(1, "5,7,5,9", 5), (2, None, 5), (3, "1,2", 5)], "id int, seq string, ad int")
    assert one(df, sequence.candidate_count("seq", "ad")) == [2, 0, 0]
    assert one(df, sequence.candidate_distance("seq", "ad")) == [2, 0, 0]


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(1, [3, 0, 4]), (2, [1]), (3, [1, 2, 3, 4, 5])], "id int, codes array<int>")
    df = df.withColumn("p", sequence.padded("codes", F.lit(4)))
    assert one(df, "p") == [[3, 0, 4, 0], [1, 0, 0, 0], [1, 2, 3, 4]]
    assert one(df, sequence.mask("p")) == [[1, 0, 1, 0], [1, 0, 0, 0], [1, 1, 1, 1]]
    assert one(df, sequence.positions_from_end(F.lit(4)))[0] == [3, 2, 1, 0]


def test_history_edges(spark):
    rows = [(i, v) for i, v in enumerate([None, 0.05, 0.1, 0.2, 1.0, 1.01, 11.0, float("nan")])]
    df = spark.createDataFrame(rows, "id int, h double")
    assert one(df, history.rate_bin("h"))[:7] == [4, 0, 1, 2, 3, 4, 4]
    assert one(df, history.above("h", 0.2))[:5] == [None, 0, 0, 0, 1]
    assert one(df, history.above("h", 0.2, 0))[0] == 0
    clipped = one(df, history.rate_clipped("h"))
    assert clipped[0] is None and clipped[6] == 10.0 and math.isnan(clipped[7])
    assert one(df, history.rate_log("h"))[0] == 0.0


def test_depth_edges(spark):
    df = spark.createDataFrame(list(enumerate([None, -5001.0, -1000.0, -500.0, -200.0, -199.0])), "id int, h double")
    assert one(df, history.depth_bin("h")) == [3, 0, 0, 1, 2, 3]
    assert one(df, history.depth_clipped("h"))[:2] == [None, -5000.0]
    assert one(df, history.above("h", -200.0)) == [None, 0, 0, 0, 0, 1]


def test_ratio_and_trend(spark):
    rows = [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, None, 1.0), (4, 2.0, 1.0), (5, 1.0, 2.0), (6, float("nan"), 1.0), (7, 1.0, -1e-6)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = one(df, history.shift_ratio("a", "b"))
    assert got[1] == 0.0 and got[2] is None and got[5] == 0.0 and got[6] is None
    assert one(df, history.trend("a", "b"))[:5] == [0, 0, 0, 1, -1]


def test_hours_and_days(spark):
    df = spark.createDataFrame([(h, h) for h in [*range(24), None, 30]], "id int, hour int")
    df = df.withColumn("id", F.coalesce("id", F.lit(99)))
    period = dict(df.select("id", temporal.hour_period("hour")).collect())
    assert [period[h] for h in (0, 5, 6, 11, 12, 17, 18, 23, 99)] == [0, 0, 1, 1, 2, 2, 3, 3, None]
    segment = dict(df.select("id", temporal.time_segment("hour")).collect())
    assert segment[30] == "other" and segment[99] == "other" and segment[0] == "midnight" and segment[5] == "early"
    days = spark.createDataFrame([(d,) for d in range(1, 8)], "id int")
    assert one(days, temporal.is_weekend("id", "sat_sun")) == [0, 0, 0, 0, 0, 1, 1]
    assert one(days, temporal.is_weekend("id", "fri_sat")) == [0, 0, 0, 0, 1, 1, 0]
    assert one(days, temporal.is_weekend("id", "from_fri")) == [0, 0, 0, 0, 1, 1, 1]


def test_casts(spark):
    df = spark.createDataFrame([(1, "5"), (2, "5.0"), (3, "x"), (4, None)], "id int, t string")
    assert one(df, values.safe_int("t")) == [5, 5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(values.strict_int("t")).collect()


def test_crosses_propagate_null(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "a", None)], "id int, x string, y string")
    assert one(df, cross.joined_text("x", "y")) == ["a_b", None, None]
    assert one(df, cross.hash_cross("x", "y", 10))[1:] == [None, None]
    assert one(df, cross.hash_cross("x", "y", 10, "xxhash64"))[1] is None


def test_group_statistics(spark):
    rows = [(1, None, None, None), (2, 4.0, None, None), (3, 1.0, 2.0, None), (4, 1.0, 2.0, 6.0), (5, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, g_1 double, g_2 double, g_3 double")
    cols = ["g_1", "g_2", "g_3"]
    out = features.group_stats(df, {"g": (cols, horizontal.STATS)})
    assert "_g_mean" not in out.columns
    assert one(out, "g_mean") == [None, 4.0, 1.5, 3.0, 0.0]
    assert one(out, "g_max") == [None, 4.0, 2.0, 6.0, 0.0]
    assert one(out, "g_min") == [None, 4.0, 1.0, 1.0, 0.0]
    assert one(out, "g_sum") == [0.0, 4.0, 3.0, 9.0, 0.0]
    std = one(out, "g_std")
    assert std[0] is None and std[1] is None and std[4] == 0.0
    assert std[2] == pytest.approx(math.sqrt(0.5)) and std[3] == pytest.approx(math.sqrt(7.0))
    assert one(df, horizontal.nonzero_count(cols)) == [0, 1, 2, 3, 0]
    single = features.group_stats(df, {"g": (["g_1"], ("max", "min"))})
    assert one(single, "g_max") == [None, 4.0, 1.0, 1.0, 0.0]


def test_fill_missing_replaces_nan_and_null(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, None, "x")], "id int, v double, t string")
    out = features.fill_missing(df).orderBy("id").collect()
    assert [(r.v, r.t) for r in out] == [(0.0, ""), (0.0, "x")]


def test_missing_inputs_are_skipped(spark):
    df = spark.createDataFrame([(1, "1,2")], "id int, seq string")
    made = features.tree_features(df).columns
    assert "seq_length" in made and "history_a_1_bin" not in made and "age_hour" not in made
    assert features.two_stage_features(spark.createDataFrame([(1, 2.0)], "id int, other double")).columns == ["id", "other"]


def test_day_text_reaches_the_weekend_rule(spark):
    """A day kept as the text of a double still gives a weekend flag in stage 2."""
    df = spark.createDataFrame([(1, "5", "13"), (2, "2", "x")], "id int, day_of_week string, hour string")
    out = features.two_stage_features(df).orderBy("id").collect()
    assert [r.is_weekend for r in out] == [1, 0]
    assert [r.hour_period for r in out] == [2, 0]
    assert [r.day_hour_cross for r in out] == ["5.0_3.0", ""]


def test_encoders_agree_on_unknown_and_empty(spark):
    df = spark.createDataFrame([(1, "a,b,a"), (2, None), (3, ""), (4, "zz,b"), (5, "b,,a")], "id int, seq string")
    vocabulary = encode.seq_vocabulary([df.where("id = 1")])
    by_array = {r.id: r.codes for r in encode.seq_encode(df, vocabulary).collect()}
    by_join = {r.id: r.codes for r in encode.seq_encode(df, vocabulary, limit=1).collect()}
    assert by_array == by_join == {1: [1, 2, 1], 2: [0], 3: [0], 4: [0, 2], 5: [2, 0, 1]}


def test_lookup_gives_the_same_without_broadcast(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"v{i % 3}") for i in range(60)], "id int, c string")
    table = encode.frequency_table(df, ["c"])
    small = encode.apply_frequency(df, table, ["c"]).collect()
    large = encode.apply_frequency(df, table, ["c"], limit=0).collect()
    assert sorted(small) == sorted(large)
    assert {r.c_freq for r in small if r.c is None} == {0.0}
