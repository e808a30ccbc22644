"""Alignment of two tokenizers by interval coalescing, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. All their tokens are sorted by start and the running maximum of their ends is taken; a group breaks
where a start reaches it, so a group is a longest run of bytes within which some token of one always lies across the cuts of the other. All pairs of an A and a B token
of a group are links. Texts are cut where neither tokenizer joins anything: before single blanks between other characters and, as far as B's pieces allow, around single line breaks and between a letter
and a stop. The groups of such chunks are kept, at most STORED chunks of SHORT characters in a worker, the recently used ones, since corpora repeat their words.

Each text is encoded once. What is written for it is its counts, the digest of its groups and its distinct id pairs with their multiplicity. A pair's count, the
number of documents that hold it linked, is an aggregation over these. The most frequent pairs, COMMON at most whatever the corpus, are looked up where the written rows are
read; the others, each of which is rare, are exploded and joined. The highest count of each A id is a table no longer than A's vocabulary.

Defined results. A document is a row; repeated rows each count and each give a row. Null and empty texts, and texts whose joined token bytes differ from a blank and the text
(such as those that hold B's mark), have no tokens: zeros and an empty digest. Texts may be of any length; pairs within a large group are counted from its distinct ids. An empty table gives no rows.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored

MARK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
STOPS = ".,;:!?"
#: In front of a chunk without a blank; no text in UTF-8 holds it.
BARE = "\udc00"
SHORT = 64
STORED = 400_000
#: Characters of texts that are encoded together, links above which a group is counted by its distinct ids.
TOGETHER = 500_000
LARGE = 4096
#: Pairs at most that are looked up by the tasks that read the rows.
COMMON = 1 << 20
USE_STEPS = 16
#: Fields of a chunk's counts in one integer: A tokens, B tokens, groups, links, chunks whose bytes differ.
FIELD = 64
_READY: dict[tuple, Aligner] = {}


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """A tokenizer as a function from texts to lists of ids, with the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            import public_tokenizers
            import tiktoken
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            known = byte_characters()
            with open(path, encoding="utf-8") as lines:
                vocab = json.load(lines)["model"]["vocab"]
            size = max(max(vocab.values()) + 1, model.get_vocab_size())
            self.bytes = [b""] * size
            for token, i in vocab.items():
                self.bytes[i] = bytes(known[c] for c in token)
            # short chunks by the same vocabulary as ranks, without the offsets and strings that come with each encoding
            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            brief = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.encode = lambda texts: [
                brief(t[1:] if t[0] == BARE else " " + t) if len(t) <= SHORT else model.encode(t[1:] if t[0] == BARE else " " + t, add_special_tokens=False).ids for t in texts
            ]
            self.cut = None
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
            # a chunk without a blank is encoded after a line break, which joins nothing
            self.encode = lambda texts: [ids[2:] if t[0] == BARE else ids for t, ids in zip(texts, model.encode([f"\n{t[1:]}" if t[0] == BARE else t for t in texts], num_threads=1))]
            self.cut = None
            if not any("\n" in p for p in pieces) and len(model.encode("\n")) == 2:
                stops = "".join(c for c in STOPS if not any(re.search(rf"[^\W\d_]\{c}", p) for p in pieces))
                self.cut = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)" + (rf"|(?<=[^\W\d_])(?=[{stops}])" if stops else ""))
        self.size = len(self.bytes)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.said = [str(i) for i in range(self.size)]

    def equal(self, ids: list[list[int]], chunks: list[bytes]) -> bool:
        """Do the ids of each chunk stand for its bytes?"""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())
        ends = np.concatenate(([0], np.cumsum(self.lengths[flat])))[np.cumsum(sizes)]
        return bool((ends == np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))).all()) and b"".join(map(self.bytes.__getitem__, flat.tolist())) == b"".join(chunks)


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group number of each A and each B token, and the number of groups; the tokens of both lie end to end from 0."""
    n = len(a_ends)
    starts = np.concatenate((np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))))
    ends = np.concatenate((a_ends, b_ends))
    order = np.lexsort((np.arange(len(ends)) >= n, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.concatenate(([True], starts[order][1:] >= reach[:-1]))
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[:n], group[n:], int(breaks.sum())


def links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Pairs (a * width + b) of the small groups, one for each link, with their group; of large groups <group, distinct pairs, multiplicities>."""
    ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_a, first_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
    large = np.flatnonzero(ca * cb > LARGE)
    fan = cb.copy()
    fan[large] = 0
    each = fan[ga]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[ga], each)
    pairs = np.repeat(a, each) * width + b[at]
    held = []
    for g in large.tolist():
        ua, na = np.unique(a[first_a[g] : first_a[g] + ca[g]], return_counts=True)
        ub, nb = np.unique(b[first_b[g] : first_b[g] + cb[g]], return_counts=True)
        held.append((g, (ua[:, None] * width + ub).ravel(), (na[:, None] * nb).ravel()))
    return pairs, np.repeat(ga, each), held


class Aligner:
    """Aligns chunks and keeps the short ones in two generations; one for each pair of files and Python worker."""

    def __init__(self, a_path: str, b_path: str, limit: int = STORED):
        self.a, self.b, self.limit = Tokens(a_path), Tokens(b_path), limit
        self.width = self.b.size
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def chunks(self, text: str) -> list[str]:
        """The parts of a blank and the text, without the blank they start with; others start with BARE."""
        out: list[str] = []
        fine = self.b.cut
        for part in CUT.split(text):
            if part.isalpha() or not fine:
                out.append(part)
            else:
                first, *others = fine.split(part)
                out.append(first)
                out += [BARE + o for o in others]
        return out

    def learn(self, chunks: list[str], into: dict[str, tuple]) -> None:
        """Add <groups as text, packed counts, pairs, held> of each chunk; a chunk whose bytes differ has only that mark."""
        a_ids, b_ids, kept = self.a.encode(chunks), self.b.encode(chunks), chunks
        whole = [c[1:].encode() if c[0] == BARE else b" " + c.encode() for c in chunks]
        if not (self.a.equal(a_ids, whole) and self.b.equal(b_ids, whole)):
            good = [self.a.equal([x], [w]) and self.b.equal([y], [w]) for x, y, w in zip(a_ids, b_ids, whole)]
            into.update((c, ("", 1 << (4 * FIELD), b"", ())) for c, ok in zip(chunks, good) if not ok)
            a_ids, b_ids, kept = ([x for x, ok in zip(column, good) if ok] for column in (a_ids, b_ids, chunks))
        if not kept:
            return
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        ga, gb, n = coalesce(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        pairs, pair_group, held = links(a, b, ga, gb, n, self.width)
        last_a, last_b = np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids])
        last_group = ga[last_a - 1]  # chunks end with a token of each, so their groups are their own
        stops = np.searchsorted(pair_group, last_group, "right").tolist()
        cut_a, cut_b = np.searchsorted(ga, np.arange(n + 1)), np.searchsorted(gb, np.arange(n + 1))
        said_a, said_b = list(map(self.a.said.__getitem__, a.tolist())), list(map(self.b.said.__getitem__, b.tolist()))
        groups = [f"{said_a[x]}|{said_b[y]}" for x, y in zip(cut_a[:-1].tolist(), cut_b[:-1].tolist())]
        for g in np.flatnonzero((np.diff(cut_a) > 1) | (np.diff(cut_b) > 1)).tolist():
            groups[g] = f"{','.join(said_a[cut_a[g]:cut_a[g + 1]])}|{','.join(said_b[cut_b[g]:cut_b[g + 1]])}"
        pairs = pairs.astype("<u8")
        of_group = {g: (p, m) for g, p, m in held}
        start, g = 0, 0
        for chunk, ids, other, stop, end in zip(kept, a_ids, b_ids, stops, (last_group + 1).tolist()):
            own = [of_group[x] for x in range(g, end) if x in of_group] if of_group else ()
            n_links = stop - start + sum(int(m.sum()) for _, m in own)
            packed = len(ids) | len(other) << FIELD | (end - g) << 2 * FIELD | n_links << 3 * FIELD
            into[chunk] = (";".join(groups[g:end]), packed, pairs[start:stop].tobytes(), tuple(own))
            start, g = stop, end

    def align(self, texts: list[str]) -> list[tuple]:
        """<n_a, n_b, n_groups, n_links, digest, distinct pairs, multiplicities> of each text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        wanted = dict.fromkeys(c for chunks in cut for c in chunks)
        if len(self.known) + len(wanted) > self.limit // 2:
            self.known, self.older = {}, self.known
        once: dict[str, tuple] = {}
        known, older = self.known, self.older
        new = []
        for c in wanted:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        brief = [c for c in new if len(c) <= SHORT][: self.limit // 2]
        for k in range(0, len(brief), 8192):
            self.learn(brief[k : k + 8192], known)
        rest = [c for c in new if c not in known]
        for k in range(0, len(rest), 256):
            self.learn(rest[k : k + 256], once)
        return [self.joined([known.get(c) or once[c] for c in chunks]) for chunks in cut]

    def joined(self, found: list[tuple]) -> tuple:
        nothing = np.zeros(0, np.int64)
        counts = sum(f[1] for f in found)
        if not found or counts >> (4 * FIELD):
            return 0, 0, 0, 0, "", nothing, nothing
        pairs, times = np.unique(np.frombuffer(b"".join([f[2] for f in found]), "<u8"), return_counts=True)
        held = [x for f in found if f[3] for x in f[3]]
        if held:
            pairs, back = np.unique(np.concatenate([pairs, *[p for p, _ in held]]).astype("<u8"), return_inverse=True)
            every = np.concatenate([times, *[m for _, m in held]])
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, back, every)
        mask = (1 << FIELD) - 1
        numbers = [counts >> (k * FIELD) & mask for k in range(4)]
        return *numbers, sha256(";".join([f[0] for f in found]).encode()).hexdigest(), pairs.astype(np.int64), times


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _READY:
        _READY[key] = Aligner(a_path, b_path)
    return _READY[key]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str, width: int, span: int) -> DataFrame:
    """<doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times> of each row of <doc_id, text>."""
    number = IntegerType() if span <= 2**31 else LongType()
    schema = StructType([
        docs.schema["doc_id"], *[StructField(c, LongType()) for c in NUMBERS], StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(number, False)), StructField("times", ArrayType(LongType(), False)),
    ])
    kind = pa.int32() if span <= 2**31 else pa.int64()

    def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()).cast(kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            first, held, size = 0, [], 0
            for k in range(len(texts) + 1):
                if k < len(texts):
                    held.append(texts[k].as_py() or "")
                    size += len(held[-1])
                if held and (size >= TOGETHER or k == len(texts)):
                    found = list(zip(*model.align(held)))
                    columns = [ids.slice(first, len(held)), *[pa.array(c, pa.int64()) for c in found[:4]], pa.array(found[4], pa.string()), listed(found[5], kind), listed(found[6], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    first, held, size = first + len(held), [], 0

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def common_pairs(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent of <pair, n>: ``most`` at most, all those from a count on."""
    stepped = counts.withColumn("step", F.floor(F.log2("n") * USE_STEPS))
    least, total = None, 0
    for r in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return stepped.where(F.col("step") >= F.lit(least)).select("pair", "n")


def _looked_up(rows: DataFrame, common: DataFrame, highest: np.ndarray, width: int) -> DataFrame:
    """The rows with n_best and count_sum over their common pairs, and what is left of pairs and times."""
    table = common.toArrow()
    order = np.argsort(pairs := table["pair"].to_numpy().astype(np.int64))
    shared = rows.sparkSession.sparkContext.broadcast((pairs[order], table["n"].to_numpy()[order], highest))
    keep = [c for c in rows.columns if c not in ("pairs", "times")]
    fields = [rows.schema[c] for c in keep] + [StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("pairs", ArrayType(LongType(), False)), StructField("times", ArrayType(LongType(), False))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses, top = shared.value
        for batch in batches:
            column = batch.column("pairs")
            bounds = column.offsets.to_numpy()
            flat = column.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64)
            times = batch.column("times").flatten().to_numpy()
            bounds = bounds - bounds[0]
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            n = np.where(hit, uses[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            best = np.where(hit & (n == top[flat // width]), times, 0)

            def summed(values: np.ndarray) -> pa.Array:
                sums = np.concatenate(([0], np.cumsum(values)))
                return pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())

            left = np.concatenate(([0], np.cumsum(~hit)))[bounds]
            rare = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~hit], pa.int64())) for v in (flat, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], summed(best), summed(times * n), *rare], names=[f.name for f in fields])

    return rows.mapInArrow(work, StructType(fields))


def align(docs: DataFrame, a_path: str, b_path: str, most: int = COMMON) -> DataFrame:
    """<doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256> of each row of <doc_id, text>."""
    spark = docs.sparkSession
    first, second = Tokens(a_path), Tokens(b_path)
    width, span = second.size, first.size * second.size
    rows = stored(aligned(docs, a_path, b_path, width, span).withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    # one row for each id of A at most
    top = counts.groupBy(F.expr(f"pair DIV {width}").alias("a")).agg(F.max("n").alias("top")).toArrow()
    highest = np.zeros(first.size, np.int64)
    highest[top["a"].to_numpy()] = top["top"].to_numpy()
    common = common_pairs(counts, most)
    found = stored(_looked_up(rows, common, highest, width), "alignment-counts")
    own = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    open_ = F.size("pairs") > 0
    if found.where(open_).isEmpty():
        return found.select(*own)
    done = found.where(~open_).select(*own)
    rare = found.where(open_).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    tops = F.broadcast(spark.createDataFrame(top.to_pandas()).select(F.col("a").cast("long").alias("a"), F.col("top").cast("long").alias("top")))
    rare = rare.join(counts, "pair").withColumn("a", F.expr(f"pair DIV {width}")).join(tops, "a")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    late = found.where(open_).join(sums, "row").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return done.unionByName(late.select(*own))
