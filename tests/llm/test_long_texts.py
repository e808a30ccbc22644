"""Very long texts, chunks of texts against the whole tokenizer, and the rules of op9 by the contract's expressions."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from clickloom.llm import attribution, chat, encoding, pii
from clickloom.llm.encoding import LONG_BLANKS, byte_pairs, ordinary_ids
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
MILLION = 1_000_000
# The contract's expressions.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_contract(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def test_rules_by_the_contract_on_random_texts():
    rng = random.Random(11)
    for alphabet in ("a@b._ -", "01.9 ", "0123456789 -.+()", "a1.@+%_é- \n", "@.a", "+1 ()", "00.255"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == by_contract(text), text


def test_rules_by_the_contract_on_documents(spark):
    from clickloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_contextual_pii"](spark, sf).collect():
        spans = by_contract(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


@pytest.mark.parametrize("text, spans", [
    ("0" * MILLION, 0), ("7" * MILLION, 0), ("a" * MILLION + "@", 0), ("a" * MILLION + "@b.c", 1), ("1." * (MILLION // 2), 0), ("0" * MILLION + ".1.2.3", 1), ("@" * MILLION, 0), ("a@" * (MILLION // 2), 0), ("+1" * (MILLION // 2), 0), (" " * MILLION, 0),
])
def test_long_runs_take_linear_time(spark, text, spans):
    start = time.time()
    found = pii.base_spans(text)
    assert time.time() - start < 20 and (len(found) == spans or text.startswith("1."))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    assert {r.doc_id for r in pii.report(docs).collect()} == {1, 2}


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "　", " \n"])
def test_long_blanks_give_the_pattern_s_ids(run, monkeypatch):
    model = byte_pairs(BYTES)
    texts = [f"a{run * 40}b", run * 41, f"{run * 40}", f" x{run * 30} y{run * 33}\x85", f"{run * 35}é", "no run at all"]
    plain = [model.encode_ordinary(t) for t in texts]
    monkeypatch.setattr("clickloom.llm.encoding.LONG_BLANKS", re.compile(LONG_BLANKS.pattern.replace("10000", "20")))
    assert [ordinary_ids(model, t) for t in texts] == plain


@pytest.mark.parametrize("text", [" " * MILLION, "\n" * MILLION, "x" + " " * MILLION + "y", "a\n" * 1000 + "\t" * MILLION])
def test_long_blanks_in_documents_and_chats(spark, text):
    model = byte_pairs(BYTES)
    ids = ordinary_ids(model, text)
    assert model.decode(ids) == text
    rows = attribution.section_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES)
    assert rows.agg({"n_tokens": "sum"}).first()[0] == len(ids)
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns, BYTES), BYTES).first().loss_chars == len(text)


@pytest.mark.parametrize("limit, block", [(1_000_000, 8 << 20), (50, 40)])
def test_chunks_give_the_tokenizer_s_ids(limit, block, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK", block)
    model, encoder, rng = Tokenizer.from_file(WORDS), encoding.ChunkEncoder(WORDS, limit), random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in (
        "a'st .", "ab'.,! \n", "aé̸=<'s ", "A1'd2, \t", "ßöÖÿ÷×a.", "İıſKΣσ'a", "a\x00\x1c\x85\xa0　 .", "中文ab1٣Ⅷ²ª_ -", "'reveml l", "́a ‍.é'",
    ) for _ in range(300)]
    texts += ["x<|endoftext|>y Z.", "<|EndOfText|> A's", "<|startoftext|>'s a.b", "<|", "", " ", "\n"]
    found = list(encoder.encode(pa.array([None, *texts]).slice(1)))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_most_new_chunks_are_words_for_the_model_alone(monkeypatch):
    encoder, slow = encoding.ChunkEncoder(WORDS), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda chunks: (slow.extend(chunks), learn(chunks)))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()
    model = Tokenizer.from_file(WORDS)
    for found, text in zip(encoder.encode(texts), texts.to_pylist(), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == model.encode(text or "", add_special_tokens=False).ids
    assert 5 * len(slow) < len(encoder.known)
