"""SentencePiece encoding and decoding as a relational lattice.

A text's words (cuts are made wherever no piece can lie across) meet the piece table by equality: the substrings of a word that can be pieces are exploded, their lengths bounded by
the pieces that begin alike, and joined to the table; the edges found are grouped by word and folded with higher-order aggregates. For unigram models the fold is Viterbi's. For BPE models, whose scores are
merge ranks, the best path is not what the model says; there the fold takes the edges in the order of their ranks and merges over a bit mask of the open cuts. One
pass is enough: a piece that its own merges give is complete before its rank comes, whatever stands beside it, and no other piece ever arises (``piece_ranks`` leaves those out). Characters without a piece become byte pieces.

The most used words, COMMON at most whatever the corpus, are counted over all texts, encoded once and looked up by the tasks that read the texts. The other words, each of which is rare, stay where their text is read: the
task hands on one row for each text, with open places, and after the first of the texts read together one for each rare word that it has not met lately; explode and broadcast join keep them in place and in order, and one Arrow function groups the rows that follow each other, without a shuffle, and folds them by the same rules. Every row
carries its number, and that function stops with an error if the order was ever lost. So neither texts nor ids move between tasks. What a task remembers is bounded by HELD_STRETCHES, HELD_WORDS and HELD_CHARACTERS.

The piece table is broadcast: it has MAX_PIECES rows at most, whatever the corpus. Words longer than LONG characters (lines without spaces) are folded by the same rule in a
Python function, since the mask has 63 bits.

Defined results. Null and empty texts have no ids. Repeated rows each give a row, empty tables none; columns other than doc_id and text are not looked at. Texts may hold any character and be of any length; ties between equal merges go to the left, ties between
paths to the longer last piece. Decoding gives back the text, with a space for every mark.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored

MARK = "▁"
LONG = 60
MAX_PIECES = 1 << 20
UNKNOWN_PENALTY = 10.0
COMMON = 1 << 18
#: Distinct stretches between spaces that a task holds, their characters, rare words that it numbers, and the texts whose rows it hands on together.
HELD_STRETCHES = 1 << 18
HELD_WORDS = 1 << 19
HELD_CHARACTERS = 1 << 24
TEXTS = 512
#: Bytes after which texts are no longer read together.
TEXT_BYTES = 1 << 22
#: Rows that are grouped and folded together, unless they have HELD_CHARACTERS bytes before.
ROWS = 1 << 16
#: Characters by which the lengths of the pieces that begin alike are found.
PREFIX = 4
#: Stretches whose words are found at once.
TOGETHER = 1 << 12
#: Steps of the logarithm of a word's uses among which the least use of a common word is chosen.
USE_STEPS = 16


@lru_cache
def vocabulary(path: str) -> tuple[list[tuple[str, int, float]], int]:
    """<piece, id, score> of the ordinary pieces, and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if len(plain) > MAX_PIECES:
        raise ValueError(f"over {MAX_PIECES} pieces")
    return plain, model.piece_to_id("<0x00>")


@lru_cache
def piece_scores(path: str) -> dict[str, tuple[int, float]]:
    return {p: (i, s) for p, i, s in vocabulary(path)[0]}


@lru_cache
def piece_ranks(path: str) -> dict[str, int]:
    """Rank of each piece of several characters that its own merges give; the best score has rank 0."""
    plain, byte = vocabulary(path)
    places = {score: rank for rank, score in enumerate(sorted({s for *_, s in plain}, reverse=True))}
    known = piece_scores(path)
    return {p: places[s] for p, i, s in plain if len(p) > 1 and merge_long(p, known, byte) == [i]}


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """<piece, rank, cost>: cost is the score's negative, rank null for pieces that no merges give."""
    rows = [(p, piece_ranks(path).get(p), -s) for p, _, s in vocabulary(path)[0]]
    return F.broadcast(spark.createDataFrame(rows, "piece string, rank long, cost double"))


def prefix_table(spark: SparkSession, path: str, shortest: int) -> DataFrame:
    """<prefix, sizes>: the lengths from ``shortest`` on of the pieces that begin with the prefix, or are its beginning; for prefixes below PREFIX, which end a word, of those within it."""
    sizes: dict[str, set[int]] = {}
    for piece, *_ in vocabulary(path)[0]:
        sizes.setdefault(piece[:PREFIX], set()).add(len(piece))
        for k in range(1, min(PREFIX, len(piece))):
            # what is left at the end of a word
            sizes.setdefault(piece[:k], set())
    for prefix, own in sizes.items():
        own |= {k for k in range(1, len(prefix)) if prefix[:k] in piece_scores(path)}
    rows = [(p, sorted(k for k in own if k >= shortest)) for p, own in sizes.items()]
    return F.broadcast(spark.createDataFrame(rows, "prefix string, sizes array<int>"))


@lru_cache
def word_pattern(path: str) -> re.Pattern:
    """A run of marks with the run of characters after it that pieces join to each other.

    Characters that are neighbours in some piece are of one family, directly or through others; no piece lies across a
    change of family, before a mark, or beside a character that is in no longer piece.
    """
    family: dict[str, str] = {}

    def root(c: str) -> str:
        while family.setdefault(c, c) != c:
            c = family[c]
        return c

    for piece, *_ in vocabulary(path)[0]:
        own = piece.lstrip(MARK)
        if MARK in own:
            raise ValueError(f"a piece joins a mark to what is before it: {piece}")
        for a, b in zip(own, own[1:]):
            family[root(a)] = root(b)
    members: dict[str, str] = {}
    for c in sorted(family):
        members[root(c)] = members.get(root(c), "") + re.escape(c)
    runs = "".join(f"[{m}]+|" for m in members.values())
    return re.compile(f"{MARK}*(?:{runs}[^{MARK}])|{MARK}+")


STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def stretches(text: str | None) -> list[str]:
    """The marked text cut before each run of marks, every part without its first mark; words never lie across such a cut."""
    if not text:
        return []
    if "  " in text or MARK in text or " " in (text[0], text[-1]):
        return [part[1:] for part in STRETCH.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of TEXTS rows at most and about TEXT_BYTES of <text>."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    group = np.arange(batch.num_rows) // TEXTS
    cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(sizes // TEXT_BYTES) != 0)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


def values_of(column: pa.Array | pa.ChunkedArray) -> list:
    """The values of texts, bytes or booleans, null as None; several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def distinct_stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct stretches of texts, the number among them of every stretch, and the bounds of the texts."""
    texts = pc.fill_null(texts, "")
    odd = pc.equal(texts, "")
    for match in (pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
        odd = pc.or_(odd, match)
    parts = pc.split_pattern(texts, " ")
    odd = odd.to_numpy(zero_copy_only=False)
    if odd.any():
        own = pa.array([stretches(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        places = np.where(odd, len(texts) + np.cumsum(odd) - 1, np.arange(len(texts)))
        parts = pa.concat_arrays([parts, own]).take(pa.array(places))
    coded = parts.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
    return coded.dictionary, coded.indices.to_numpy(), bounds


def words_of(parts: list[str], pattern: re.Pattern) -> Iterator[list[str]]:
    """The words of stretches, TOGETHER stretches at a time; one that is empty or ends with a mark would give its marks to the next and goes alone."""
    plain = [p for p in parts if p and p[-1] != MARK]
    for i in range(0, len(plain), TOGETHER):
        yield pattern.findall(MARK + MARK.join(plain[i : i + TOGETHER]))
    if len(plain) < len(parts):
        yield from (pattern.findall(MARK + p) for p in parts if not p or p[-1] == MARK)


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """<word, uses> of the distinct words of <text>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held, size = word_pattern(path), {}, 0

        def flush() -> pa.RecordBatch:
            counts, alike = Counter(), {}
            for stretch, uses in held.items():
                alike.setdefault(uses, []).append(stretch)
            held.clear()
            for uses, parts in alike.items():
                for words in words_of(parts, pattern):
                    if uses == 1:
                        counts.update(words)
                    else:
                        for word in words:
                            counts[word] += uses
            made = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["word", "uses"])

        for batch in (part for b in batches for part in together(b)):
            found, numbers, _ = distinct_stretches(batch.column("text"))
            for stretch, uses in zip(values_of(found), np.bincount(numbers, minlength=len(found)).tolist()):
                held[stretch] = held.get(stretch, 0) + uses
            lengths = pc.utf8_length(found).to_numpy()
            size += int(lengths[lengths > LONG].sum())
            if len(held) > HELD_STRETCHES or size > HELD_CHARACTERS:
                yield flush()
                size = 0
        yield flush()

    return docs.select("text").mapInArrow(work, "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def merged_cuts(merges: Column, n: Column) -> Column:
    """The open cuts of a word of n characters after all merges, as a mask.

    ``merges`` are the word's pieces of several characters as numbers: rank, start and end, the last two of 6 bits each. In this order a
    piece is merged if the cuts at its ends and just one inner cut are open.
    """

    def step(mask: Column, merge: Column) -> Column:
        start, end = F.shiftright(merge, 6).bitwiseAND(F.lit(63)).cast("int"), merge.bitwiseAND(F.lit(63)).cast("int")
        inner = _bit(end) - _bit(start + F.lit(1))
        both = _bit(start).bitwiseOR(_bit(end))
        may = (mask.bitwiseAND(both) == both) & (F.bit_count(mask.bitwiseAND(inner)) == 1)
        return F.when(may, mask.bitwiseAND(F.bitwise_not(inner))).otherwise(mask)

    return F.aggregate(F.sort_array(merges), _bit(n + F.lit(1)) - F.lit(1), step)


def viterbi_cuts(edges: Column, n: Column, unknown: float) -> Column:
    """The cuts of the best path; a character without a piece costs ``unknown``. Ties go to the longer last piece."""

    def reach(best: Column, end: Column) -> Column:
        came = F.filter(edges, lambda e: e["end"] == end)
        options = F.transform(came, lambda e: F.struct((F.get(best, e["start"])["score"] - e["cost"]).alias("score"), (-e["start"]).alias("left")))
        byte = F.struct((F.get(best, end - F.lit(1))["score"] + F.lit(unknown)).alias("score"), (F.lit(1) - end).alias("left"))
        single = F.exists(came, lambda e: e["start"] == end - F.lit(1))
        best_one = F.array_max(F.when(single, options).otherwise(F.concat(options, F.array(byte))))
        return F.concat(best, F.array(best_one))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("left")))
    table = F.aggregate(F.sequence(F.lit(1), n), first, reach)

    def walk(path: Column) -> Column:
        start = F.struct(_bit(n).alias("mask"), n.alias("at"))
        step = lambda a, _: let(-F.get(path, a["at"])["left"], lambda p: F.struct(F.when(a["at"] > 0, a["mask"].bitwiseOR(_bit(p))).otherwise(a["mask"]).alias("mask"), F.when(a["at"] > 0, p).otherwise(F.lit(0)).alias("at")))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["mask"])

    return let(table, walk)


def cut_ids(word: str, mask: int, plain: dict[str, tuple[int, float]], byte: int) -> list[int]:
    """Ids of the parts between the open cuts: the part's piece, or the bytes of a character that has none."""
    ids, start, mask = [], 0, mask & ~1
    while mask:
        end = (mask & -mask).bit_length() - 1
        if known := plain.get(word[start:end]):
            ids.append(known[0])
        else:
            ids += [byte + c for c in word[start:end].encode()]
        start, mask = end, mask & (mask - 1)
    return ids


def merge_long(word: str, plain: dict[str, tuple[int, float]], byte: int) -> list[int]:
    """The ids of one word by merging, best score first, then leftmost."""
    parts: list[str | None] = list(word)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (piece := plain.get(parts[a] + parts[b])):
            heapq.heappush(heap, (-piece[1], a, b, len(parts[a]) + len(parts[b])))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if parts[a] is None or parts[b] is None or right[a] != b or len(parts[a]) + len(parts[b]) != size:
            continue
        parts[a], parts[b] = parts[a] + parts[b], None
        right[a] = right[b]
        if right[a] >= 0:
            left[right[a]] = a
        offer(left[a], a)
        offer(a, right[a])
    return [i for p in parts if p is not None for i in ([plain[p][0]] if p in plain else [byte + c for c in p.encode()])]


def viterbi_long(word: str, plain: dict[str, tuple[int, float]], byte: int, unknown: float, longest: int) -> list[int]:
    """The ids of one word by Viterbi's best path; ties as in ``viterbi_cuts``."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        known = [(best[s][0] + plain[word[s:end]][1], -s) for s in range(max(0, end - longest), end) if word[s:end] in plain]
        if word[end - 1] not in plain:
            known.append((best[end - 1][0] + unknown, 1 - end))
        best.append(max(known))
    ends, at = [], len(word)
    while at:
        ends.append(at)
        at = -best[at][1]
    cuts = [0, *reversed(ends)]
    parts = [word[s:e] for s, e in zip(cuts, cuts[1:])]
    return [i for p in parts for i in ([plain[p][0]] if p in plain else [byte + c for c in p.encode()])]


def whole_ids(path: str, fold: str) -> Callable[[str, int | None], list[int]]:
    """The function <word, mask> to ids; words over LONG characters have no mask."""
    plain, (table, byte) = piece_scores(path), vocabulary(path)
    longest, unknown = max(len(p) for p, *_ in table), min(s for *_, s in table) - UNKNOWN_PENALTY

    def ids(word: str, mask: int | None) -> list[int]:
        if len(word) <= LONG:
            return cut_ids(word, mask, plain, byte)
        return merge_long(word, plain, byte) if fold == "bpe" else viterbi_long(word, plain, byte, unknown, longest)

    return ids


def lattice_edges(rows: DataFrame, path: str, fold: str) -> DataFrame:
    """One row for each row of ``rows``, with edge null, and then one for each piece found in its <word>; the other columns stay.

    ``edge`` holds start and end of the piece and, for merging, its rank above them; ``cost`` is kept for Viterbi only. Rows stay in their partition and order. Words that are null or
    longer than LONG have no edges.
    """
    shortest = 2 if fold == "bpe" else 1
    spark, kept, n = rows.sparkSession, rows.columns, F.length("word")
    last = F.coalesce(F.when(n <= LONG, n - shortest + 1), F.lit(0))
    spans = rows.select(*kept, F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("at"))
    spans = spans.withColumn("prefix", F.when(F.col("at") > 0, F.substring("word", F.col("at"), F.lit(PREFIX))))
    spans = spans.join(prefix_table(spark, path, shortest), "prefix", "left")
    unlisted = F.array(*[F.lit(k) for k in range(shortest, PREFIX)])
    sizes = F.when(F.col("at") == 0, F.array(F.lit(0))).otherwise(F.coalesce("sizes", unlisted))
    spans = spans.select(*kept, "at", F.explode(sizes).alias("size")).where("size = 0 or size <= length(word) - at + 1")
    spans = spans.withColumn("piece", F.when(F.col("size") > 0, F.substring("word", F.col("at"), F.col("size"))))
    found = spans.join(piece_table(spark, path), "piece", "left")
    place = (F.col("at").cast("long") - 1) * 64 + F.col("at") - 1 + F.col("size")
    edge = F.when(F.col("size") > 0, place + F.col("rank") * 4096 if fold == "bpe" else F.when(F.col("cost").isNotNull(), place))
    found = found.select(*kept, "size", edge.alias("edge"), *(["cost"] if fold == "viterbi" else []))
    return found.where("edge is not null or size = 0").drop("size")


def open_cuts(word: Column, edges: Column, path: str, fold: str) -> Column:
    """The mask of a word's cuts from its edges: numbers for merging, <edge, cost> for Viterbi."""
    n = F.length(word)
    if fold == "bpe":
        mask = merged_cuts(edges, n)
    else:
        at = lambda e: e["edge"].cast("int")
        named = F.transform(edges, lambda e: F.struct(e["cost"].alias("cost"), F.shiftright(at(e), 6).alias("start"), at(e).bitwiseAND(F.lit(63)).alias("end")))
        mask = let(named, lambda e: viterbi_cuts(e, n, min(s for *_, s in vocabulary(path)[0]) - UNKNOWN_PENALTY))
    return F.when(n <= LONG, mask)


def encode_words(words: DataFrame, path: str, fold: str = "bpe") -> DataFrame:
    """<word, ids> of distinct words <word>."""
    found = lattice_edges(words.select("word"), path, fold)
    edge = F.col("edge") if fold == "bpe" else F.when(F.col("edge").isNotNull(), F.struct("edge", "cost"))
    masks = found.groupBy("word").agg(F.collect_list(edge).alias("edges")).select("word", open_cuts(F.col("word"), F.col("edges"), path, fold).alias("mask"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = whole_ids(path, fold)
        for batch in batches:
            ids = [of(w, m) for w, m in zip(batch.column("word").to_pylist(), batch.column("mask").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return masks.mapInArrow(work, "word string, ids array<int>")


def common_words(table: DataFrame, most: int = COMMON) -> DataFrame:
    """The most used words of <word, uses>: ``most`` at most, all those above a number of uses."""
    step = F.floor(F.log2("uses") * USE_STEPS)
    table = table.where(F.length("word") <= LONG).withColumn("step", step)
    least, total = None, 0
    for r in sorted(table.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return table.where(F.col("step") >= F.lit(least)).select("word")


class _Codes(dict):
    """The ids of a stretch as 32-bit numbers; the rare word that was met as the nth since the last start is -n."""

    def __init__(self, known: dict[str, bytes], pattern: re.Pattern):
        super().__init__()
        self.known, self.pattern, self.numbers, self.new, self.characters, self.long = known, pattern, {}, [], 0, 0

    def __missing__(self, stretch: str) -> bytes:
        parts = []
        for word in self.pattern.findall(MARK + stretch):
            code = self.known.get(word) or self.numbers.get(word)
            if code is None:
                self.new.append(word)
                code = self.numbers[word] = (-1 - len(self.numbers)).to_bytes(4, "little", signed=True)
                self.long += len(word)
            parts.append(code)
        self[stretch] = code = b"".join(parts)
        self.characters += len(stretch)
        return code

    def trim(self) -> bool:
        """Make room where it is needed; true if the numbers start again."""
        restart = len(self.numbers) >= HELD_WORDS or self.long >= HELD_CHARACTERS
        if restart or len(self) >= HELD_STRETCHES or self.characters >= HELD_CHARACTERS:
            self.clear()
            self.characters = 0
        if restart:
            self.numbers.clear()
            self.long = 0
        return restart


def _looked_up(docs: DataFrame, path: str, common: DataFrame) -> DataFrame:
    """For each text a row <seq, doc_id, ids, fresh>, and one <seq, word> for each new word that is not in ``common``, those of texts read together after the first of them.

    ``ids`` are 32-bit numbers; -n stands for the ids of the nth other word since the last row that is fresh.
    """
    found = common.toArrow()
    codes = [np.array(ids, "<i4").tobytes() for ids in found["ids"].to_pylist()]
    shared = docs.sparkSession.sparkContext.broadcast((found["word"].to_pylist(), codes))
    names = ["seq", "doc_id", "ids", "fresh", "word"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seq = _Codes(dict(zip(*shared.value)), word_pattern(path)), 0
        for batch in (part for b in batches for part in together(b)):
            n, fresh, memo.new = batch.num_rows, memo.trim(), []
            found, numbers, bounds = distinct_stretches(batch.column("text"))
            codes = pa.array(list(map(memo.__getitem__, values_of(found))), pa.large_binary()).take(pa.array(numbers))
            offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1][bounds]
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), codes.buffers()[2]])
            k = len(memo.new)
            source = pa.array([0, *[None] * k, *range(1, n)], pa.int64())
            places = pa.array(np.arange(seq, seq + n + k))
            seq += n + k
            flags = pa.array([fresh, *[None] * k, *[False] * (n - 1)], pa.bool_())
            words = pa.array([None, *memo.new, *[None] * (n - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([places, batch.column("doc_id").take(source), ids.take(source).cast(pa.binary()), flags, words], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"seq long, doc_id {kind}, ids binary, fresh boolean, word string")


def fold_merges(edges: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``merged_cuts`` of many words at once: word i has the next sizes[i] edges and lengths[i] characters."""
    edges = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) + edges) & 0xFFFFFFFF
    order, starts = np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes
    starts, counts = starts[order], sizes[order]
    masks, one = (np.int64(1) << (lengths[order] + 1)) - 1, np.int64(1)
    for k in range(int(counts[0]) if len(counts) else 0):
        live = np.searchsorted(-counts, -k)
        edge, mask = edges[starts[:live] + k], masks[:live]
        start, end = edge >> 6 & 63, edge & 63
        both, inner = one << start | one << end, (one << end) - (one << start + 1)
        cut = mask & inner
        may = (mask & both == both) & (cut != 0) & (cut & cut - 1 == 0)
        masks[:live] = np.where(may, mask & ~inner, mask)
    result = np.empty_like(masks)
    result[order] = masks
    return result


def fold_paths(edges: np.ndarray, costs: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, unknown: float) -> np.ndarray:
    """``viterbi_cuts`` of many words."""
    masks, at = [], 0
    for size, n in zip(sizes.tolist(), lengths.tolist()):
        came: dict[int, list] = {}
        for edge, cost in zip(edges[at : at + size].tolist(), costs[at : at + size].tolist()):
            came.setdefault(edge & 63, []).append((edge >> 6, cost))
        at += size
        best = [(0.0, 0)]
        for end in range(1, n + 1):
            options = [(best[s][0] - c, -s) for s, c in came.get(end, [])]
            if not any(s == end - 1 for s, _ in came.get(end, [])):
                options.append((best[end - 1][0] + unknown, 1 - end))
            best.append(max(options))
        mask, end = 1, n
        while end:
            mask, end = mask | 1 << end, -best[end][1]
        masks.append(mask)
    return np.array(masks, np.int64)


def texts_of(lists: pa.ListArray, path: str) -> pa.Array:
    """The texts of lists of ids; ids that are no ordinary piece or byte stand for nothing, null lists for no text."""
    parts = _parts(path)
    ids, none = lists.flatten().to_numpy(zero_copy_only=False), len(parts) - 1
    joined = parts.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1][ends]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), joined.buffers()[2]])
    return pa.array([raw[i].as_py().decode("utf-8", "replace").replace(MARK, " ")[1:] if known else None for i, known in enumerate(lists.is_valid().to_pylist())], pa.string())


@lru_cache
def _parts(path: str) -> pa.Array:
    plain, byte = vocabulary(path)
    codes = {i: p.replace(MARK, " ").encode() for p, i, _ in plain} | {byte + b: bytes([b]) for b in range(256)}
    return pa.array([codes.get(i, b"") for i in range(max(codes) + 2)], pa.large_binary())


def _filled(found: DataFrame, path: str, fold: str, decoded: bool) -> DataFrame:
    """<doc_id, ids> (and text) from the rows of ``lattice_edges``: those that belong together are grouped and folded, and the ids of rare words put in their places."""
    kept = ["ids", "fresh", "word"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, before, rest, text, new = whole_ids(path, fold), -1, None, None, []
        unknown = min(s for *_, s in vocabulary(path)[0]) - UNKNOWN_PENALTY

        def masks_of(table: pa.Table, heads: np.ndarray, words: list[str | None]) -> list[int]:
            """The masks of a group's rows, one for each head."""
            nonlocal before
            seq = table["seq"].to_numpy()
            sizes = np.diff(np.append(heads, len(seq)))
            if (np.diff(seq[heads], prepend=before) != 1).any() or (np.repeat(seq[heads], sizes) != seq).any():
                raise RuntimeError("rows lost their order between explode and grouping")
            before = seq[-1]
            inner = np.ones(len(seq), bool)
            inner[heads] = False
            edges = pc.fill_null(table["edge"], 0).to_numpy()[inner]
            lengths = np.array([0 if w is None or len(w) > LONG else len(w) for w in words])
            if fold == "bpe":
                return fold_merges(edges, sizes - 1, lengths).tolist()
            return fold_paths(edges, pc.fill_null(table["cost"], 0.0).to_numpy()[inner], sizes - 1, lengths, unknown).tolist()

        def closed() -> np.ndarray:
            own = np.frombuffer(text[1], "<i4")
            places = np.flatnonzero(own < 0)
            if not len(places):
                return own
            put = [new[-1 - n] for n in own[places].tolist()]
            at = np.repeat(places - np.arange(len(places)), [len(ids) // 4 for ids in put])
            return np.insert(own[own >= 0], at, np.frombuffer(b"".join(put), "<i4"))

        def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *(len(ids) for _, ids in done)]), pa.int32())
            values = pa.array(np.concatenate([ids for _, ids in done]).astype(np.int32), pa.int32())
            made = {"doc_id": pa.array([d for d, _ in done], kind), "ids": pa.ListArray.from_arrays(offsets, values)}
            return pa.RecordBatch.from_pydict(made | ({"text": texts_of(made["ids"], path)} if decoded else {}))

        def through(table: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal text
            first, done = table.select(["doc_id", *kept]).take(pa.array(heads)), []
            docs = iter(first["doc_id"].filter(pc.is_null(first["word"])).to_pylist())
            shown = [values_of(first[c].combine_chunks()) for c in kept]
            masks = masks_of(table, heads, shown[-1])
            for ids, fresh, word, mask in zip(*shown, masks):
                if word is not None:
                    new.append(array("i", of(word, mask)).tobytes())
                    continue
                if text is not None:
                    done.append((text[0], closed()))
                text = next(docs), ids
                if fresh:
                    new.clear()
            if done:
                yield batch_of(done, table.schema.field("doc_id").type)

        for batch in batches:
            rest = pa.Table.from_batches(([] if rest is None else rest.to_batches()) + [batch])
            if len(rest) < ROWS and rest.nbytes < HELD_CHARACTERS:
                continue
            heads = np.flatnonzero(rest["edge"].is_null().to_numpy())
            if len(heads) > 1:
                yield from through(rest.slice(0, heads[-1]), heads[:-1])
                rest = rest.slice(heads[-1])
        if rest is not None and len(rest):
            yield from through(rest, np.flatnonzero(rest["edge"].is_null().to_numpy()))
        if text is not None:
            yield batch_of([(text[0], closed())], rest.schema.field("doc_id").type)

    return found.mapInArrow(work, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, ids array<int>{', text string' if decoded else ''}")


def encode(docs: DataFrame, path: str, fold: str = "bpe", most: int = COMMON, decoded: bool = False) -> DataFrame:
    """<doc_id, ids> of each row of <doc_id, text>; with ``decoded`` also the text that the ids give."""
    common = common_words(stored(count_words(docs, path), "words"), most)
    rows = _looked_up(docs, path, stored(encode_words(common, path, fold), "common"))
    found = lattice_edges(rows, path, fold)
    shown = [F.when(F.col("edge").isNull(), F.col(c)).alias(c) for c in rows.columns if c != "seq"]
    return _filled(found.select("seq", *shown, *[c for c in found.columns if c not in rows.columns]), path, fold, decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """<doc_id, ids> with the text of the ids; ids that are no ordinary piece or byte stand for nothing, null ids for no text."""
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts_of(batch.column("ids"), path)], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kinds['doc_id']}, ids {kinds['ids']}, text string")
