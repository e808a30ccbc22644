"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns of every operator."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from clickloom.llm import attribution, chat, packing, pieces, pii, quality, sharding, simhash, topk, warc
from clickloom.llm.common import components

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, fp string, shard string"
LONG = " ".join(f"word{i % 977}" for i in range(30000))
ROWS = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "one two three"), (4, LONG), (5, LONG), (6, " \t\n "), (7, "Ünï 中文\n\n token = \"x\"  é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, "s", "k", "f", "h") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


OPERATORS = {
    "quality": (quality.score, len(ROWS)),
    "simhash": (simhash.near_duplicates, len(ROWS)),
    "pii": (pii.report, len(ROWS)),
    "sharding": (sharding.interleave, len(ROWS)),
    "pieces": (lambda d: pieces.encode(d, PIECES), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_kept(docs, none, name):
    operator, rows = OPERATORS[name]
    assert operator(docs).count() == rows
    assert operator(none).count() == 0


def test_stage_operators_keep_columns(docs, none):
    for stage in (quality.keep, simhash.one_per_group, pii.redact):
        assert stage(docs).columns == docs.columns and stage(none).count() == 0
    assert pii.redact(docs).count() == len(ROWS)
    kept = [r.doc_id for r in simhash.one_per_group(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4, 7] and None in kept


def test_quality_counts(spark):
    run = " ".join("abcdefgh")
    rows = [(1, f"{run} {run}\nx\nx\n \n", "en"), (2, "a " * 40, "en"), (3, None, None)]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].n_dup_lines) == (18, 16, 1)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].kept) == (40, 40, False)
    assert (got[3].n_words, got[3].base_failed) == (0, True)


def test_simhash_hot_keys_equal_joined_keys(spark):
    random.seed(3)
    centre = random.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        v = random.choice(sorted(values))
        for _ in range(random.randint(1, 3)):
            v ^= 1 << random.randrange(64)
        values.add(v)
    values |= {random.getrandbits(64) for _ in range(30)}
    signed = np.array(sorted(values), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    parts = [{tuple(r) for r in components(simhash.links(df, joined=j, group=g)).collect()} for j, g in ((1000, 20000), (2, 20000), (2, 4))]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) >= 150


def test_components_of_a_chain(spark):
    order = list(range(64))
    random.Random(5).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(chain).collect())
    assert all(got[i] == 0 for i in range(64)) and got[101] == got[100] == 100


def test_packing_edges(docs, none):
    rows = packing.pack(docs, WORDS).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.doc_id == 3 for r in rows) >= 2 and packing.pack(none, WORDS).count() == 0


def test_sum_of_squares_level_array():
    packer, count = packing.SumOfSquares(10), {}
    for size in random.Random(1).choices(range(1, 10), k=300):
        before = {h: n for h, n in enumerate(packer.count) if n}
        window, level = packer.place(size)

        def squares(h):
            after = dict(before)
            if h:
                after[h] -= 1
            if h + size < 10:
                after[h + size] = after.get(h + size, 0) + 1
            return sum(n * n for n in after.values())

        assert squares(level) == min(squares(h) for h in [0, *[h for h in before if h + size <= 10]])
        assert count.get(window, 0) == level
        count[window] = level + size


def test_pii_contexts_find_the_unseen(spark):
    rows = [(i, f'say token = "{hashlib.sha1(bytes([i])).hexdigest()}" now') for i in range(30)]
    rows += [(90, 'say token = "ZQ-1234-5678-ABCD" now'), (91, "clean words only, version 12345678901234 here"), (92, None)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90].spans == "identifier:13:30" and got[91].spans == "" and got[92].spans == ""
    texts = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[90] == 'say token = "<IDENTIFIER>" now' and texts[92] is None


@pytest.mark.parametrize("seed, unseen", [
    ("+49 30 {:03d}-4567", "0049-30-765-4321"), ("10.20.30.{}", "10.20.300.4000"), ("user{}@mail.example.org", "john.smith1234@intranet"), ("{:040x}", "ZQ-1234-5678-ABCD"),
])
def test_pii_every_seed_kind_finds_the_unseen(spark, seed, unseen):
    rows = [(i, f"please call me at {seed.format(i + 7 * 16**30 if 'x' in seed else i)} soon") for i in range(30)] + [(90, f"please call me at {unseen} soon")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90] == f"identifier:18:{18 + len(unseen)}"


def test_pii_unseen_as_many_as_seeds(spark):
    plants = {  # context, seed, unseen
        "reach us on": ("+49 30 {:03d}-4567", "(555) {:03d}-4567"),
        "social number": ("+1 212 555 {:04d}", "{:03d}-45-6789"),
        "badge key": ("{:040x}", "EMP-48{:03d}"),
        "passport key": ("{:040x}", "AB1234{:03d}"),
        "mail to": ("user{}@mail.example.org", "john.{}@intranet"),
    }
    rows, expected = [], {}
    for p, (context, (seed, unseen)) in enumerate(plants.items()):
        for i in range(20):
            name = "".join(chr(97 + int(c)) for c in str(i)) if "@" in unseen else i
            key = i + (7 + p) * 16**30 if "x" in seed else i
            rows.append((1000 * p + i, f"please {context} {seed.format(key)} soon"))
            text = unseen.format(name)
            rows.append((1000 * p + 500 + i, f"please {context} {text} soon"))
            expected[1000 * p + 500 + i] = f"identifier:{8 + len(context)}:{8 + len(context) + len(text)}"
    # ordinary numbers, and numbers of a card's length that are no cards
    rows += [(9000 + i, f"at {i % 10} of {i % 10} in {i % 10} by {i % 10} part {4000000000000 + 977 * i} x") for i in range(200)]
    rows += [(9500 + i, f"part at +49 30 {i:03d}-9999 x") for i in range(8)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in expected} == expected
    assert not any("identifier" in s for i, s in got.items() if i >= 9000)


def test_pii_overlapping_spans_leave_nothing(spark):
    texts = ["10.0.0.0 5500 0000 0000 0004 x", "y +49 30 1234567.name@mail.org z", "a@b.cc 1.2.3.4"]
    assert len(pii.base_spans(texts[0])) == 2 and len(pii.base_spans(texts[1])) == 2
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "<IP> x", 1: "y <PHONE> z", 2: "<EMAIL> <IP>"}


def test_pii_rules():
    text = "a.b@c.de 1.2.3.4 x 999.1.1.1 x 4111 1111-1111 1111 x 4111111111111112 +49 (30) 123-4567"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+49 (30) 123-4567"),
    ]


@pytest.mark.parametrize("text", ["", "  a  b ", "x" * 300, "▁▁ mark", "tab\tnew\nline", "中文 é ﬁ \U0001f600", "Aaaa" * 40 + " b"])
def test_sentencepiece_edges(spark, text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES)
    assert encoded.first().ids == model.encode(text)
    if "▁" not in text:
        assert (pieces.decode(encoded, PIECES).first().text or "") == text


@pytest.mark.parametrize("most", [0, 40])
def test_sentencepiece_rare_words(docs, most):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode(docs, PIECES, most=most).collect()
    expected = [(i, model.encode(t or "")) for i, t in ROWS]
    assert sorted(((r.doc_id or 0, r.ids) for r in got)) == sorted((i or 0, ids) for i, ids in expected)


def test_sentencepiece_folds(spark, docs):
    """Rare and common words give the same ids under both folds, also over 60 characters; the decoded text is the text."""
    rows = [(i, t) for i, t in ROWS if i not in (4, 5)] + [(8, "x  y " + "straßenbahn" * 9 + " 漢" * 3 + "thething" * 8), (9, "  the"), (10, "the  "), (11, " ")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    for fold in ("bpe", "viterbi"):
        rare, common = (sorted((r.doc_id or 0, r.ids, r.text) for r in pieces.encode(texts, PIECES, fold, most, decoded=True).collect()) for most in (0, pieces.COMMON))
        assert rare == common and [(i, t) for i, _, t in rare] == sorted((i or 0, t or "") for i, t in rows)
    again = pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, [-1, 10**6])], "doc_id long, ids array<int>"), PIECES)
    assert {r.doc_id: r.text for r in again.collect()} == {1: None, 2: "", 3: ""}


def test_stretches_of_texts_read_together():
    """The words of many texts at once, against those of each whole text; ends of words are listed, so they meet no lengths that no piece has."""
    texts = [t for _, t in ROWS] + [None, "", " ", "a  b ", "▁", "▁▁x y▁", "z " * 3, "\U0001f600 x", "a b c a"]
    found, numbers, bounds = pieces.distinct_stretches(pa.array(texts, pa.string()))
    own = [[found[i].as_py() for i in numbers[s:e]] for s, e in zip(bounds, bounds[1:])]
    assert own == [pieces.stretches(t) for t in texts]
    pattern = pieces.word_pattern(PIECES)
    words = sorted(w for part in pieces.words_of([s for each in own for s in each], pattern) for w in part)
    assert words == sorted(w for t in texts if t for w in pattern.findall(pieces.MARK + t.replace(" ", pieces.MARK)))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * pieces.TEXT_BYTES, None, "y"] + ["z"] * 2 * pieces.TEXTS, pa.string())})
    slices = list(pieces.together(batch))
    assert pa.Table.from_batches(slices).to_pydict() == batch.to_pydict() and max(b.num_rows for b in slices) <= pieces.TEXTS


def test_one_pass_merges():
    """The fold in the order of the ranks against merging the best neighbours, on words made of pieces."""
    known, (plain, byte), ranks = pieces.piece_scores(PIECES), pieces.vocabulary(PIECES), pieces.piece_ranks(PIECES)
    draw = random.Random(5)
    words = ["".join(draw.choice(plain)[0] for _ in range(draw.randint(1, 4)))[: pieces.LONG] for _ in range(4000)]
    edges = [[ranks[w[s:e]] * 4096 + s * 64 + e for s in range(len(w)) for e in range(s + 2, min(len(w), s + 16) + 1) if w[s:e] in ranks] for w in words]
    masks = pieces.fold_merges(np.array([e for own in edges for e in own]), np.array([len(own) for own in edges]), np.array([len(w) for w in words]))
    for word, mask in zip(words, masks.tolist()):
        assert pieces.cut_ids(word, mask, known, byte) == pieces.merge_long(word, known, byte)


def test_viterbi_fold(spark):
    """Against the best of all splits, with the scores taken as log-probabilities."""
    plain, _ = pieces.vocabulary(PIECES)
    scores, ids = {p: s for p, _, s in plain}, {p: i for p, i, _ in plain}
    unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY

    def best(word):
        table = [(0.0, [])]
        for end in range(1, len(word) + 1):
            table.append(max((table[s][0] + scores[word[s:end]], table[s][1] + [word[s:end]]) for s in range(max(0, end - 16), end) if word[s:end] in scores))
        return table[-1]

    words = ["▁thething", "▁representation", "▁xqzab", "▁in"]
    got = pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), PIECES, fold="viterbi").collect()
    back = {i: p for p, i in ids.items()}
    for r in got:
        assert sum(scores[back[i]] for i in r.ids) == best(r.word)[0] and "".join(back[i] for i in r.ids) == r.word
    assert unknown < 0


def test_chat_escapes_and_masks(spark):
    odd = ["<|im_start|>", "<\\|im_end|>", "<<|", "<\\\\|", "", None, "a\nb", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "ro\nle\\<|", t) for i, t in enumerate(odd)] + [(None, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, BYTES), BYTES).collect()}
    whole = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:8])
    loss = "".join(t or "" for i, t in enumerate(odd) if i % 2)
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[2].n_turns, got[None].n_turns) == (2, 1)
    assert chat.read_back(chat.format_turns(turns.where("conv_id = 9"), BYTES), BYTES).count() == 0


def test_warc_edges(spark, tmp_path):
    rows = [(3, "http://a b\r\n", "same"), (1, None, "same"), (1, None, "same"), (5, "u", None), (4, "u", ""), (None, "n", "same"), (6, "v", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\né")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    found = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert len(found) == len(rows) and {r.refers_id for r in found} - {None} <= {r.record_id for r in found if r.record_type == "response"}
    types = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert types == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (6, "response", None)]
    warc.write_archives(pages.where("page_id = 99"), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0


def test_topk_edges(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    vectors[100:200] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, df.where("vec_id % 50 = 0")).collect()
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    expected = set()
    for q in range(0, 300, 50):
        scores = whole @ whole[q]
        order = [i for i in sorted(range(300), key=lambda i: (-scores[i], i)) if i != q][:5]
        expected |= {(q, r + 1, i, int(scores[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == expected
    assert topk.search(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("large", [65536.0, -3.0e6, 5.0e14])
def test_topk_keeps_large_components(spark, large):
    vectors = np.random.default_rng(4).normal(0, 0.2, (120, 8))
    vectors[[50, 70], 3] = large, -large / 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = [0, 50, 100] if large < 1e9 else [0, 100]
    got = topk.search(df, df.where(df.vec_id.isin(queries))).collect()
    whole = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    expected = set()
    for q in queries:
        scores = [sum(a * b for a, b in zip(whole[q], v)) for v in whole]
        order = [i for i in sorted(range(120), key=lambda i: (-scores[i], i)) if i != q][:5]
        expected |= {(q, r + 1, i, scores[i]) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == expected


def test_topk_exact_beyond_64_bits():
    q, x = np.array([[2**60, 1]], dtype=object), np.array([[2**10, 0], [2**10, 1], [-(2**70), 3], [2**9, 9]], dtype=object)
    found = list(topk.exact_top(q, np.array([9]), x, np.arange(4), np.zeros(4, bool), 2))
    assert [(i, s) for _, i, s, _ in found] == [(1, 2**70 + 1), (0, 2**70)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_rules_add_up(docs, none, rule):
    from clickloom.llm.encoding import byte_pairs

    model = byte_pairs(BYTES)
    rows = attribution.section_tokens(docs, BYTES, rule).where("doc_id != 3").collect()
    for i, t in ROWS:
        if i not in (None, 3):
            assert sum(r.n_tokens for r in rows if r.doc_id == i) == pytest.approx(len(model.encode_ordinary(t or "")))
    assert attribution.section_tokens(none, BYTES, rule).count() == 0


def test_shards_follow_the_mixture(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 7) END AS source")
    placed = sharding.interleave(docs, shards=8, bucket_rows=37)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 8
    for r in placed.groupBy("stratum").pivot("shard").count().na.fill(0).collect():
        counts = list(r)[1:]
        assert max(counts) - min(counts) <= 2
    assert placed.groupBy("shard").agg({"slot": "max"}).selectExpr("max(`max(slot)`)").first()[0] == 124
    assert [tuple(x) for x in placed.orderBy("position").collect()] == [tuple(x) for x in sharding.interleave(docs, shards=8, bucket_rows=5000).orderBy("position").collect()]
