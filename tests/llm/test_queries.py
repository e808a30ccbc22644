"""Queries with SQL against DuckDB; the others against brute force over the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from clickloom.llm import pii, simhash
from clickloom.llm.queries import ORACLE_SQL, QUERIES
from clickloom.plans.queries.registry import Entry
from compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, name):
    assert compare(oracle(SF), Entry(QUERIES[name], ORACLE_SQL[name]), spark, SF) is None


def test_sentencepiece_equals_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in QUERIES["op2_sentencepiece"](spark, SF).collect()}
    assert got == {i: model.encode(t) for i, t in texts.items()}


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = [*model.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    open_ = 0
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        open_ += at < 4096
    assert open_ <= 1


def test_simhash_components(spark, texts):
    ids = sorted(texts)
    prints = np.array([simhash.fingerprint_of(texts[i]) for i in ids], dtype=np.uint64)
    lowest = list(range(len(ids)))
    changed = True
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while changed:
        new = [min(lowest[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        changed, lowest = new != lowest, new
    expected = {(i, f"{prints[k]:016x}", ids[lowest[k]]) for k, i in enumerate(ids)}
    assert {tuple(r) for r in QUERIES["op7_simhash"](spark, SF).collect()} == expected


def test_pii_base_spans(spark, texts):
    for r in QUERIES["op9_contextual_pii"](spark, SF).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        named = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base}
        assert named <= set(r.spans.split(","))


def test_section_tokens_add_up(spark, texts):
    from clickloom.llm.encoding import byte_pairs

    model = byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = defaultdict(list)
    for r in QUERIES["op10_section_tokens"](spark, SF).collect():
        rows[r.doc_id].append(r)
    for i, t in texts.items():
        found = sorted(rows[i], key=lambda r: r.section)
        assert "".join(t[r.start : r.end] for r in found) == t
        expected, at, data = [0] * len(found), 0, t.encode()
        ends = np.cumsum([len(t[r.start : r.end].encode()) for r in found])
        for token in model.encode_ordinary(t):
            expected[int(np.searchsorted(ends, at, "right"))] += 1
            at += len(model.decode_single_token_bytes(token))
        assert at == len(data) and [r.n_tokens for r in found] == expected


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    verdicts = {r.doc_id for r in QUERIES["op1_quality_divergence"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdicts and kept.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    own = {r.doc_id for r in simhash.near_duplicates(kept).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in single.collect()} == own and single.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == own
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
