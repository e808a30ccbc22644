"""License scans, tokenizer alignment and collocations against brute force written anew."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from clickloom.llm import alignment, collocations, licenses
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "   ", "Plain words only.", "Licensed under the GNU Lesser General Public License, version 2.1.", "CC-BY cc by CC BY 4.0 cc by", "All rights reserved. All Rights Reserved.",
    "SPDX-License-Identifier: MIT", "x" * 3000 + " GNU General Public License", "K İ K all rights reservedé", "Apache License " * 300, "cc by " * 2000, "released under the MIT license all rights are reserved",
]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "clash", 0.5) for i, t in enumerate(texts)] + [(4, texts[4], None, "clash", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, labels string, score double")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan_against_word_lists(spark):
    got = {}
    for r in licenses.scan(documents(spark, TEXTS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[4]) == 2 and got[4][0] == got[4][1]
    for i, text in enumerate(TEXTS):
        words = words_of(text)
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i][0]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        spans = []
        for rule in licenses.rules():
            framed = "".join(f" {w} " for w in words)
            spans += [(m.start(), m.end(), rule.rank, rule.label) for m in re.finditer(rule.pattern, framed)]
        left = [s for s in spans if not any(o[2] <= s[2] and o[0] <= s[0] and o[1] >= s[1] and (o[2] < s[2] or o[:2] != s[:2]) for o in spans)] if len(spans) < 3000 else spans
        assert r.labels == ",".join(sorted({x for _, x in places} | {s[3] for s in left})), text
        assert r.score == (licenses.CONFIDENCE[min(s[2] for s in left)] if left else 0.0)
    assert got[4][0].labels == "gpl,lgpl-2.1" and got[7][0].score == 1.0 and got[12][0].labels == "mit,proprietary"
    assert licenses.scan(documents(spark, TEXTS).where("doc_id < 0")).count() == 0


def test_license_rules_are_found_by_keyword_and_literal():
    assert len(licenses.rules()) > 300
    for rule in licenses.rules():
        assert rule.keyword in rule.literal and rule.pattern.startswith((" ", "(?: "))


def brute_alignment(texts):
    """Cuts by sets of byte offsets over whole texts, pairs by two loops."""
    from tokenizers import Tokenizer
    import sentencepiece

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    known = alignment.byte_characters()
    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, ids_b = a.ids, second.encode(text or "")
        bytes_a = [bytes(known[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, pa, pb = [], 0, 0
        for c in common:
            qa, qb = ends[0].index(c, pa) + 1, ends[1].index(c, pb) + 1
            groups.append((ids_a[pa:qa], ids_b[pb:qb]))
            pa, pb = qa, qb
        found.append((ids_a, ids_b, groups))
    counts = Counter(p for f in found if f for p in {(x, y) for ga, gb in f[2] for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        every = [(x, y) for ga, gb in f[2] for x in ga for y in gb]
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in f[2])
        rows.append((len(f[0]), len(f[1]), len(f[2]), len(every), sum(counts[p] == top[p[0]] for p in every), sum(counts[p] for p in every), hashlib.sha256(said.encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  two  blanks ", "a\n\nb \tc", "▁ mark", "<|endoftext|> x <s> </s> <0x41>", "é ﬁ 中文 \U0001f600　x   y", "nul\x00 in \x00a, \x00 b.\nc;d \x00", "word " * 200, "naïveté " * 50, "x y", "ab" * 400, "\r\n x\r\n", "tail ", "ZWJ \U0001f468‍\U0001f469 z"]


@pytest.mark.parametrize("most, stored, large", [(1 << 20, 200_000, 4096), (0, 3, 2), (9, 200_000, 1)])
def test_alignment_against_brute_force(spark, monkeypatch, most, stored, large):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    df = documents(spark, texts).repartition(2)
    if stored == 200_000 and large == 4096:
        got = alignment.align(df, A, B, most)
        rows = {(r.doc_id, *[r[c] for c in COLUMNS]) for r in got.collect()}
        expected = brute_alignment([*texts, texts[4]])
        assert rows == {(i, *x) for i, x in enumerate(expected[:-1])} and got.count() == len(texts) + 1
        assert alignment.align(df.where("doc_id < 0"), A, B).count() == 0
    else:
        monkeypatch.setattr(alignment, "LARGE", large)
        model = alignment.Aligner(A, B, stored)
        for x, y in zip(model.align([t or "" for t in texts]), brute_alignment(texts)):
            assert (*x[:4], x[4]) == (*y[:4], y[6]) and x[6].sum() == y[3]
        whole = {tuple(r) for r in alignment.align(df, A, B).collect()}
        assert {tuple(r) for r in alignment.align(df, A, B, most).collect()} == whole


def test_alignment_of_very_long_runs():
    model = alignment.Aligner(A, B)
    texts = [c * 1_000_000 for c in (" ", "a", "7", "\n")]
    for text, (n_a, n_b, n_groups, n_links, digest, pairs, times) in zip(texts, model.align(texts)):
        assert min(n_a, n_b) > 0 and n_links >= n_groups > 0 and times.sum() == n_links and len(pairs) < 1000


def test_alignment_query_on_the_smallest_table(spark):
    from clickloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute_alignment([r.text for r in docs])))


def brute_collocations(rows, least, longest, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, c in counts.items():
        candidates = {g: n for g, n in c.items() if len(g) > 1 and n >= least}
        found = []
        for g, a in candidates.items():
            score, k = min((1000 * a * totals[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and 100 * m >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, m in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return set(out)


@pytest.mark.parametrize("most, limit, covered", [(1 << 17, 1 << 20, 100), (4, 64, 100), (0, 64, 60), (30, 16, 60)])
def test_collocations_against_brute_force(spark, most, limit, covered):
    rng = np.random.default_rng(7)
    names = ["the", "of", "New", "York", "é", "a", "b", "c", "中", "x y"]
    rows = [(" ".join(rng.choice(names, 40)) + "; New York\tCity. new york city, A A A A", ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(None, "en"), ("", None), ("one two. three", "xx"), ("New York City " * 50, "en")] + [("same same same same same same", "yy")] * 9
    df = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, phrase string").repartition(3)
    got = collocations.collocations(df, least=5, covered=covered, top=40, most=most, limit=limit)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 5, 5, covered, 40)
    assert collocations.collocations(df.where("text = 'none'")).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 5, 13, 17, 21])
def test_packing_of_numbers_is_invertible(bits):
    rng = np.random.default_rng(bits)
    numbers = [rng.integers(0, 1 << bits, 5000).astype(np.uint64) for _ in range(5)]
    for size in range(2, 6):
        packing = collocations.Packing(bits, size)
        q, r = packing.pack(numbers[:size])
        assert all((x == y).all() for x, y in zip(packing.unpack(q, r), numbers))
        assert len(set(zip(q.tolist(), r.tolist()))) == len(set(zip(*[n.tolist() for n in numbers[:size]])))


def test_bitmap_holds_its_slots(spark):
    slots = [0, 1, 7, 8, 32767, 32768, (1 << collocations.SLOTS) - 1]
    bits = collocations.bitmap(spark.createDataFrame([(s,) for s in slots], "slot long"))
    assert collocations.has(bits, np.array(slots, np.uint64)).all() and int(np.bitwise_count(bits).sum()) == len(slots)
    assert not collocations.has(bits, np.array([2, 9, 32766, 65536], np.uint64)).any()
    assert collocations.bitmap(spark.createDataFrame([(3,)], "slot long").where(F.col("slot") < 0)).sum() == 0
