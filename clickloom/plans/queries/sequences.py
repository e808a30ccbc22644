"""Sequence queries: whole documents as item sequences, and user histories for candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import sequence as S
from ...operators import attention, encode, histories
from ...session import cut_lineage
from ...sources.impressions import impressions, table, word_sequences
from .registry import imp_sql, query, r, with_imp, with_words

LEN = "len(string_split(seq, ','))"


@query("seq_length", with_words(f"""
SELECT id, {LEN} AS seq_length, coalesce({LEN}, 0) AS seq_length_zero FROM docs"""))
def seq_length(spark, sf):
    return word_sequences(spark, sf).select(
        "id",
        S.length().cast("bigint").alias("seq_length"),
        S.length(null_length=0).cast("bigint").alias("seq_length_zero"),
    )


@query("seq_length_clipped", with_words(f"SELECT id, CASE WHEN {LEN} > 5000 THEN 5000 ELSE {LEN} END AS seq_length_clipped FROM docs"))
def seq_length_clipped(spark, sf):
    return word_sequences(spark, sf).select(
        "id", S.length_clipped(S.length()).cast("bigint").alias("seq_length_clipped")
    )


@query("seq_length_log", with_words(f"SELECT id, round(ln(1 + {LEN}), 6) AS seq_length_log FROM docs"))
def seq_length_log(spark, sf):
    return word_sequences(spark, sf).select("id", r(S.length_log(S.length()), alias="seq_length_log"))


def _bins(edges):
    chain = " ".join(f"WHEN {LEN} <= {e} THEN {i}" for i, e in enumerate(edges))
    return f"CASE {chain} ELSE {len(edges)} END"


@query("seq_length_bin", with_words(f"""
SELECT id, {_bins((100, 200, 500, 1000))} AS seq_length_bin,
  CAST({_bins((100, 200, 500, 1000))} AS VARCHAR) AS seq_length_bin_str,
  {_bins((5, 20, 40, 60))} AS fine_bin FROM docs"""))
def seq_length_bin(spark, sf):
    n = S.length()
    return word_sequences(spark, sf).select(
        "id",
        S.length_bin(n).alias("seq_length_bin"),
        S.length_bin(n).cast("string").alias("seq_length_bin_str"),
        S.length_bin(n, (5, 20, 40, 60)).alias("fine_bin"),
    )


@query("seq_very_short", with_words(f"SELECT id, CAST({LEN} <= 100 AS TINYINT) AS seq_very_short FROM docs"))
def seq_very_short(spark, sf):
    return word_sequences(spark, sf).select("id", S.very_short(S.length()).alias("seq_very_short"))


@query("seq_diversity_proxy", with_words(f"""
SELECT id, round(CAST(length(seq) AS DOUBLE) / ({LEN} * 3 + 1), 6) AS seq_diversity_proxy FROM docs"""))
def seq_diversity_proxy(spark, sf):
    return word_sequences(spark, sf).select("id", r(S.diversity_proxy("seq", S.length()), alias="seq_diversity_proxy"))


@query("seq_has_item", with_words("SELECT id, " + ", ".join(
    f"CAST(contains(seq, ',{x},') AS TINYINT) AS seq_has_{x}, "
    f"CAST(list_contains(string_split(seq, ','), '{x}') AS TINYINT) AS seq_holds_{x}"
    for x in S.FREQUENT_ITEMS) + " FROM docs"))
def seq_has_item(spark, sf):
    made = [S.has_item("seq", x).alias(f"seq_has_{x}") for x in S.FREQUENT_ITEMS]
    made += [S.has_item("seq", x, boundary=True).alias(f"seq_holds_{x}") for x in S.FREQUENT_ITEMS]
    return word_sequences(spark, sf).select("id", *made)


@query("seq_diversity", with_words(f"""
SELECT id, coalesce(CAST(len(list_distinct(string_split(seq, ','))) AS INTEGER), 0) AS seq_unique_count,
  round(coalesce(len(list_distinct(string_split(seq, ','))), 0) / CAST(coalesce({LEN}, 0) + 1 AS DOUBLE), 6) AS seq_diversity
FROM docs"""))
def seq_diversity(spark, sf):
    n = S.length(null_length=0)
    return word_sequences(spark, sf).select(
        "id",
        S.unique_count().alias("seq_unique_count"),
        r(S.diversity(S.unique_count(), n), alias="seq_diversity"),
    )


@query("seq_truncated", with_words("""
SELECT id, array_to_string(string_split(seq, ',')[1:100], ',') AS seq_truncated,
  array_to_string(string_split(seq, ',')[-100:], ',') AS seq_newest FROM docs"""))
def seq_truncated(spark, sf):
    return word_sequences(spark, sf).select(
        "id", S.truncated("seq").alias("seq_truncated"), S.truncated("seq", side="tail").alias("seq_newest")
    )


VOCABULARY = f"""WITH {imp_sql("seq")},
found AS (
  SELECT DISTINCT item FROM (
    SELECT unnest(string_split(seq, ',')) AS item FROM imp WHERE seq <> ''
    UNION ALL SELECT CAST(l_feat_14 AS VARCHAR) FROM imp WHERE l_feat_14 IS NOT NULL) x)"""


@query("seq_vocabulary", f"""{VOCABULARY}
SELECT item, CAST(row_number() OVER (ORDER BY item) AS INTEGER) AS idx FROM found""")
def seq_vocabulary(spark, sf):
    """Items of train and test histories and all candidate ads, from events; no history text is built."""
    return encode.item_vocabulary(_all_items(spark, sf))


def _all_items(spark, sf):
    rows = impressions(spark, sf).select("user_id", "day", F.col("l_feat_14").cast("string").alias("item"))
    return histories.history_items(rows).unionByName(rows.where(F.col("item").isNotNull()).select("item"))


@query("seq_vocabulary_legacy", f"""{VOCABULARY}
SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS idx
FROM (SELECT item FROM found UNION SELECT '0') x""")
def seq_vocabulary_legacy(spark, sf):
    return encode.item_vocabulary(_all_items(spark, sf), legacy=True)


WORD_CODES = """
vocab AS (
  SELECT item, CAST(row_number() OVER (ORDER BY item) AS INTEGER) AS idx
  FROM (SELECT DISTINCT unnest(string_split(seq, ',')) AS item FROM docs WHERE seq <> '' AND id % 2 = 0) x),
coded AS (
  SELECT d.id, d.pos, coalesce(v.idx, 0) AS idx
  FROM (SELECT id, unnest(string_split(coalesce(nullif(seq, ''), '?'), ',')) AS item,
          generate_subscripts(string_split(coalesce(nullif(seq, ''), '?'), ','), 1) AS pos FROM docs) d
  LEFT JOIN vocab v ON v.item = d.item)"""


def _word_codes(spark, sf, encoder):
    """Vocabulary fitted on the even documents, so odd ones meet unknown items."""
    docs = word_sequences(spark, sf)
    vocabulary = encode.seq_vocabulary([docs.where(F.col("id") % 2 == 0)])
    return encoder(docs, vocabulary)


CODES_SQL = with_words("""SELECT 1""").replace("\nSELECT 1", "," + WORD_CODES)


@query("seq_encode", f"""{CODES_SQL}
SELECT id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS codes FROM coded GROUP BY id""")
def seq_encode(spark, sf):
    codes = _word_codes(spark, sf, encode.seq_encode)
    return codes.select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("seq_encode_join", f"""{CODES_SQL}
SELECT id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS codes FROM coded GROUP BY id""")
def seq_encode_join(spark, sf):
    codes = _word_codes(spark, sf, encode.seq_encode_join)
    return codes.select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("seq_numeric", with_words("""
SELECT id, CASE WHEN coalesce(seq, '') = '' THEN 1 ELSE len(string_split(seq, ',')) END AS n_items,
  CASE WHEN coalesce(seq, '') = '' THEN 0.0::DOUBLE
    ELSE CAST(list_sum([TRY_CAST(x AS FLOAT) FOR x IN string_split(seq, ',')]) AS DOUBLE) END AS item_sum
FROM docs"""))
def seq_numeric(spark, sf):
    values = S.numeric()
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return word_sequences(spark, sf).select(
        "id", F.size(values).cast("bigint").alias("n_items"), total.alias("item_sum")
    )


@query("seq_pad_mask", f"""{CODES_SQL},
rows AS (SELECT id, id // 16 AS batch, list(idx ORDER BY pos) AS codes FROM coded GROUP BY id),
wide AS (SELECT *, least(max(len(codes)) OVER (PARTITION BY batch), 100) AS width FROM rows)
SELECT id, width,
  array_to_string([coalesce(codes[i], 0) FOR i IN range(1, width + 1)], ',') AS padded,
  array_to_string([CASE WHEN coalesce(codes[i], 0) <> 0 THEN 1 ELSE 0 END FOR i IN range(1, width + 1)], ',') AS mask,
  array_to_string(range(width - 1, -1, -1), ',') AS positions,
  least(greatest(len(codes), 1), width) AS seq_len
FROM wide""")
def seq_pad_mask(spark, sf):
    """Batches of 16 rows, each padded to its longest sequence (at most 100); encoded once, a batch is its own small window."""
    coded = _word_codes(spark, sf, encode.seq_encode).withColumn("batch", F.floor(F.col("id") / 16))
    longest = F.max(F.size("codes")).over(Window.partitionBy("batch"))
    rows = coded.withColumn("width", F.least(longest, F.lit(S.MAX_ITEMS)).cast("int")).withColumn("padded", S.padded("codes", F.col("width")))

    def text(c):
        return F.array_join(c.cast("array<string>"), ",")

    return rows.select(
        "id",
        F.col("width").cast("bigint").alias("width"),
        text(F.col("padded")).alias("padded"),
        text(S.mask("padded")).alias("mask"),
        text(S.positions_from_end(F.col("width"))).alias("positions"),
        F.least(F.greatest(F.size("codes"), F.lit(1)), F.col("width")).cast("bigint").alias("seq_len"),
    )


@query("candidate_match", with_imp("""
SELECT id,
  CAST(coalesce(list_contains(items, ad), false) AS TINYINT) AS ad_seen,
  CAST(coalesce(len(list_filter(items, lambda x: x = ad)), 0) AS INTEGER) AS ad_count,
  CAST(coalesce(list_position(list_reverse(items), ad), 0) AS INTEGER) AS ad_distance
FROM (SELECT id, string_split(seq, ',') AS items, CAST(l_feat_14 AS VARCHAR) AS ad FROM imp) x""", "seq"))
def candidate_match(spark, sf):
    """From counts of each user's items before a day; no history text is built."""
    rows = impressions(spark, sf)
    return histories.candidate_match(rows, rows, candidate="l_feat_14", item="l_feat_14")


def _item_vectors(spark, sf):
    """Embedding rows stand for the items of their number."""
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vec"))


#: A candidate without a vector scores 0, an item without one is masked.
ATTENTION = f"""WITH {imp_sql("seq")},
vecs AS (SELECT CAST(vec_id AS VARCHAR) AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
bag AS (
  SELECT id, cvec, item, count(*) AS times
  FROM (SELECT i.id, c.vec AS cvec, unnest(string_split(i.seq, ',')) AS item
        FROM imp i LEFT JOIN vecs c ON c.item = CAST(i.l_feat_14 AS VARCHAR) WHERE i.seq <> '') x
  GROUP BY ALL),
scored AS (
  SELECT b.id, b.item, b.times, v.vec, CASE WHEN v.vec IS NULL THEN -1e4 ELSE coalesce(list_dot_product(b.cvec, v.vec), 0) END AS score
  FROM bag b LEFT JOIN vecs v ON v.item = b.item),
soft AS (
  SELECT *, times * exp(score - max(score) OVER (PARTITION BY id)) AS raised FROM scored),
weighted AS (SELECT *, raised / sum(raised) OVER (PARTITION BY id) AS weight FROM soft)"""


def _histories(spark, sf):
    """<id, _candidate, item, times>: each impression with the counted items of its user's history; a row without history keeps one row."""
    rows = impressions(spark, sf).select("id", "user_id", "day", F.col("l_feat_14").cast("string").alias("item"))
    bag = histories.bags(rows).withColumnRenamed("item", "_item")
    met = rows.join(bag, ["user_id", "day"], "left")
    return met.select("id", F.col("item").alias("_candidate"), F.col("_item").alias("item"), F.coalesce("times", F.lit(0)).alias("times"))


@query("attention_weights", f"""{ATTENTION}
SELECT i.id, CAST(count(w.item) AS BIGINT) AS items, CAST(coalesce(sum(times), 0) AS BIGINT) AS times,
  coalesce(round(max(weight), 6), 0) AS max_weight, coalesce(round(sum(weight * score), 4), 0) + 0.0 AS mean_score
FROM imp i LEFT JOIN weighted w ON w.id = i.id GROUP BY i.id""")
def attention_weights(spark, sf):
    weights = attention.bag_weights(_histories(spark, sf), _item_vectors(spark, sf))
    return weights.groupBy("id").agg(
        F.count("item").alias("items"),
        F.sum("times").alias("times"),
        r(F.coalesce(F.max("weight"), F.lit(0.0)), alias="max_weight"),
        r(F.coalesce(F.sum(F.col("weight") * F.col("score")), F.lit(0.0)), 4, "mean_score"),
    )


POOLED = f"""{ATTENTION},
parts AS (
  SELECT id, weight, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM weighted WHERE vec IS NOT NULL),
sums AS (SELECT id, dim, sum(weight * x) AS pooled FROM parts GROUP BY id, dim),
cells AS (SELECT id, unnest(range((SELECT max(len(vec)) FROM vecs))) AS dim FROM imp)
SELECT id, CAST(dim AS INTEGER) AS dim, coalesce(round(pooled, 5), 0) + 0.0 AS pooled FROM cells LEFT JOIN sums USING (id, dim)"""


@query("attention_pool_join", POOLED)
def attention_pool_join(spark, sf):
    """The vectors of a group of users are joined to it; no row for each impression and item of its history is shuffled."""
    rows = impressions(spark, sf).select("id", "user_id", "day", F.col("l_feat_14").cast("string").alias("item"))
    pooled = attention.pool_histories(rows, _item_vectors(spark, sf))
    return pooled.select("id", F.posexplode("pooled").alias("dim", "pooled")).select("id", "dim", r("pooled", 5))


@query("attention_pool", POOLED)
def attention_pool(spark, sf):
    """History and candidate share one vocabulary: the items that have a vector. A user's counted items are gathered once for each active day."""
    vectors = _item_vectors(spark, sf).select((F.col("item").cast("int") + 1).alias("idx"), "item", "vec")
    known = cut_lineage(vectors.select("item", "idx"))
    code = F.coalesce("idx", F.lit(0))
    rows = impressions(spark, sf).select("id", "user_id", "day", F.col("l_feat_14").cast("string").alias("item"))
    held = histories.item_arrays(histories.bags(rows).join(known, "item", "left"), code)
    asked = rows.join(known, "item", "left").select("id", "user_id", "day", code.alias("candidate_code"))
    coded = asked.join(held, ["user_id", "day"], "left")
    pooled = attention.attention_pool(coded, vectors.select("idx", "vec"), times="times")
    return pooled.select("id", F.posexplode("pooled").alias("dim", "pooled")).select("id", "dim", r("pooled", 5))
