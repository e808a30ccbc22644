"""Phrase collocations from exact n-gram counts in counting quotient filters.

Everything is per language. Words are counted first; those with fewer than LEAST occurrences can be in no phrase that is looked for. The most frequent others, VOCABULARY at most
whatever the corpus, get numbers, and the texts are written once as these numbers (0 for the rest and between pieces). Lengths 2 to LONGEST are
counted one after the other. An n-gram is its numbers packed into two limbs, which an invertible permutation spreads; the permuted high limb is the quotient, the permuted low
limb the full remainder, so nothing is lost and no two n-grams share a counter. A task keeps its n-grams as a filter, sorted by quotient and remainder and compacted
as it grows; Spark brings the rows of a quotient together, sorts them (with spilling), and the sorted filters are merged by adding equal neighbours. Those frequent enough are turned
back into words. Before a length is counted, a bitmap of fixed size tells which windows have both parts (all but the last word, all but the first) frequent; a false hit costs a counter, and
nothing is missed.

Frequent words beyond VOCABULARY, if there are any, are known to the tasks by a bitmap of fixed size; n-grams with such a word are counted as texts.

A phrase's score is the lowest floor(1000 a n / (l r)) over its cuts, in decimals that hold the products exactly. A candidate is covered if one that is a word longer and holds it has (at
COVERED percent) as many occurrences: if any longer one does, so does one that is a word longer.

Defined results. Null and empty texts have no words; a null language is "und". Repeated rows count each time. Texts of any length are taken whole. Ties in rank go to the larger a, then to the smaller
phrase by bytes. Languages without candidates have no rows, as has an empty table. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BREAKS = b".,;:!?\n\x0b\x0c\r"
ALIKE = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
LEAST = 100
LONGEST = 5
COVERED = 100
TOP = 2000
VOCABULARY = 1 << 17
USE_STEPS = 16
#: Distinct words or n-grams that a task holds before it hands on their counts; numbers in one written row.
HELD = 1 << 18
FILTER = 1 << 20
BLOCK = 1 << 16
#: The bitmaps have 2 ** SLOTS bits, in rows of 32,768.
SLOTS = 26
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def tokens(text: str) -> list[bytes]:
    """Words in lower case; a line break stands between pieces, and empty entries mean nothing."""
    return text.encode().lower().translate(ALIKE).replace(b"\n", b" \n ").split(b" ")


def count_words(docs: DataFrame) -> DataFrame:
    """<lang, word, f> over all rows of <text, lang>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                words = [w for w in found if w and w != b"\n"]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                counts.setdefault(lang.as_py(), Counter()).update(tokens(text.as_py()))
                if sum(map(len, counts.values())) > HELD:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(work, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame, most: int) -> tuple[list[tuple[str, str]], DataFrame]:
    """The most frequent of <lang, word, f>, ``most`` at most, in a fixed order, and the rows of the others."""
    stepped = words.withColumn("step", F.floor(F.log2("f") * USE_STEPS))
    least, total = None, 0
    for r in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    chosen = F.lit(False) if least is None else F.col("step") >= least
    return sorted((r.lang, r.word) for r in stepped.where(chosen).select("lang", "word").collect()), stepped.where(~chosen).select("lang", "word", "f")


class Packing:
    """N-grams of ``size`` numbers below 2 ** bits as (quotient, remainder): the first half of the numbers (or one more) in the low limb, the others in the high one, permuted invertibly."""

    def __init__(self, bits: int, size: int):
        if bits > 21 or not 2 <= size <= 6:
            raise ValueError("numbers have 21 bits at most, n-grams two to six of them")
        self.bits, self.size, self.split = bits, size, (size + 1) // 2
        self.low, self.high = self.split * bits, (size - self.split) * bits
        self.odd = [ODD[0] & self._mask(self.low) | 1, ODD[1] & self._mask(self.high) | 1]

    @staticmethod
    def _mask(bits: int) -> int:
        return (1 << bits) - 1

    def _steps(self, high: np.ndarray, low: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        lm, hm = np.uint64(self._mask(self.low)), np.uint64(self._mask(self.high))
        ls, hs = np.uint64((self.low + 1) // 2), np.uint64((self.high + 1) // 2)
        of_high = lambda h: h * np.uint64(ODD[1]) + np.uint64(1)
        of_low = lambda x: (x * np.uint64(ODD[2])) >> np.uint64(17)
        if not back:
            low = (low + of_high(high)) & lm
            low = (low * np.uint64(self.odd[0])) & lm
            low = low ^ (low >> ls)
            high = (high + of_low(low)) & hm
            high = (high * np.uint64(self.odd[1])) & hm
            return high ^ (high >> hs), low
        high = high ^ (high >> hs)
        high = (high * np.uint64(pow(self.odd[1], -1, 1 << self.high))) & hm
        high = (high - of_low(low)) & hm
        low = low ^ (low >> ls)
        low = (low * np.uint64(pow(self.odd[0], -1, 1 << self.low))) & lm
        return high, (low - of_high(high)) & lm

    def pack(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        limbs = [np.zeros(len(numbers[0]), np.uint64) for _ in range(2)]
        for k, column in enumerate(numbers):
            side, place = (1, k) if k < self.split else (0, k - self.split)
            limbs[side] |= column.astype(np.uint64) << np.uint64(place * self.bits)
        return self._steps(*limbs, back=False)

    def unpack(self, quotient: np.ndarray, remainder: np.ndarray) -> list[np.ndarray]:
        high, low = self._steps(quotient.astype(np.uint64), remainder.astype(np.uint64), back=True)
        one = np.uint64(self._mask(self.bits))
        return [((low if k < self.split else high) >> np.uint64((k if k < self.split else k - self.split) * self.bits)) & one for k in range(self.size)]

    def schema(self) -> str:
        """Limbs are as narrow as they can be where they are shuffled."""
        return f"quotient {'int' if self.high < 32 else 'long'}, remainder {'int' if self.low < 32 else 'long'}, n long"

    def added(self, quotient: np.ndarray, remainder: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by quotient and remainder, with the counts of equal n-grams added."""
        if not len(counts):
            return quotient, remainder, counts
        if self.low + self.high <= 64:
            key = quotient << np.uint64(self.low) | remainder
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key = key[first]
            return key >> np.uint64(self.low), key & np.uint64(self._mask(self.low)), np.add.reduceat(counts[order], first)
        order = np.lexsort((remainder, quotient))
        q, r = quotient[order], remainder[order]
        first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1]))))
        return q[first], r[first], np.add.reduceat(counts[order], first)


def slots(quotient: np.ndarray, remainder: np.ndarray) -> np.ndarray:
    """The place of an n-gram in a bitmap."""
    mixed = quotient * np.uint64(ODD[0]) + remainder * np.uint64(ODD[1])
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(ODD[2])
    return mixed >> np.uint64(64 - SLOTS)


class QuotientFilter:
    """Counters of n-grams, sorted by quotient and remainder; ``limit`` new ones are taken in between two merges."""

    def __init__(self, packing: Packing, limit: int = FILTER):
        self.packing, self.limit, self.waiting, self.late = packing, limit, [], 0
        self.parts = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))

    def add(self, quotient: np.ndarray, remainder: np.ndarray) -> None:
        self.waiting.append((quotient, remainder, np.ones(len(quotient), np.int64)))
        self.late += len(quotient)
        if self.late >= self.limit:
            self.merge()

    def merge(self) -> None:
        self.parts = self.packing.added(*[np.concatenate(c) for c in zip(self.parts, *self.waiting)])
        self.waiting, self.late = [], 0

    def __len__(self) -> int:
        return len(self.parts[2])


def write_numbers(docs: DataFrame, vocabulary: list[tuple[str, str]]) -> DataFrame:
    """<block>: the texts as numbers from 1 (0 between pieces and for other words), many in a row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(shared.value):
            known.setdefault(lang, {})[word.encode()] = i + 1
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                own = known.get(lang.as_py())
                if own:
                    found = np.array([own.get(w, 0) for w in tokens(text.as_py()) if w] + [0], "<u4")
                    found = found[(found != 0) | (np.concatenate((found[:1], found[:-1])) != 0)]
                    held.append(found.tobytes())
                    size += len(found)
                    if size >= BLOCK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.select("text", "lang").mapInArrow(work, "block binary")


def bitmap(slot: DataFrame) -> np.ndarray:
    """The bits that <slot> sets, from rows made by Spark: 2 ** SLOTS bits whatever the corpus."""
    at = F.col("slot") + 1
    rows = slot.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(1 << SLOTS - 3, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.bucket - 1) * 4096 :][: len(part)] = part
    return bits


def has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def windows(numbers: np.ndarray, packing: Packing, shorter: Packing | None, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Quotients and remainders of the runs of numbers without 0 whose two shorter parts are in ``bits``."""
    size = packing.size
    if len(numbers) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    columns = [numbers[k : len(numbers) - size + 1 + k] for k in range(size)]
    at = np.flatnonzero(reduce(np.logical_and, [c != 0 for c in columns]))
    if bits is not None:
        for skip in (0, 1):
            part = shorter.pack([c[at] for c in columns[skip : skip + size - 1]])
            at = at[has(bits, slots(*part))]
    return packing.pack([c[at] for c in columns])


def count_grams(blocks: DataFrame, packing: Packing, shorter: Packing | None, bits: np.ndarray | None, limit: int = FILTER) -> DataFrame:
    """<quotient, remainder, n>: the filters of all tasks, each sorted."""
    shared = blocks.sparkSession.sparkContext.broadcast(bits)
    kinds = [np.int32 if b < 32 else np.int64 for b in (packing.high, packing.low)] + [np.int64]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = QuotientFilter(packing, limit), shared.value, packing.size

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p.astype(k)) for p, k in zip(held.parts, kinds)], names=["quotient", "remainder", "n"])

        for batch in batches:
            for block in batch.column("block"):
                numbers = np.frombuffer(block.as_py(), "<u4")
                for start in range(0, len(numbers), BLOCK):
                    held.add(*windows(numbers[start : start + BLOCK + size - 1], packing, shorter, seen))
                    if len(held) >= 2 * limit:
                        held.merge()
                        yield flush()
                        held = QuotientFilter(packing, limit)
        held.merge()
        yield flush()

    return blocks.mapInArrow(work, packing.schema())


def merge_grams(counted: DataFrame, packing: Packing, vocabulary: list[tuple[str, str]], least: int) -> DataFrame:
    """<lang, phrase, size, f, slot> of the n-grams with ``least`` occurrences, by merging the sorted filters."""
    shared = counted.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value

        def frequent(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            keep = parts[2] >= least
            q, r, n = (p[keep] for p in parts)
            ids = np.stack([c.astype(np.int64) - 1 for c in packing.unpack(q, r)], axis=1).tolist()
            columns = [
                pa.array([words[g[0]][0] for g in ids], pa.string()), pa.array([" ".join([words[i][1] for i in g]) for g in ids], pa.string()),
                pa.array(np.full(len(n), packing.size), pa.int32()), pa.array(n), pa.array(slots(q, r).astype(np.int64)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "f", "slot"])

        last = None
        for batch in batches:
            parts = tuple(c.to_numpy().astype(t) for c, t in zip(batch.columns, (np.uint64, np.uint64, np.int64)))
            if last is not None:
                parts = tuple(np.concatenate(p) for p in zip(last, parts))
            if len(parts[2]):
                parts = packing.added(*parts)
                # the largest may go on in the next batch
                last = tuple(p[-1:] for p in parts)
                yield frequent(tuple(p[:-1] for p in parts))
        if last is not None:
            yield frequent(last)

    dealt = counted.repartition("quotient").sortWithinPartitions("quotient", "remainder")
    return dealt.mapInArrow(work, "lang string, phrase string, size int, f long, slot long")


def rare_grams(docs: DataFrame, vocabulary: list[tuple[str, str]], rest: DataFrame, longest: int) -> DataFrame:
    """<lang, phrase, size, f> of the n-grams that hold a word of ``rest`` and otherwise such words and words of the vocabulary.

    A word is taken for one of ``rest`` by its bit; n-grams of a word that only shares a bit are rare, as the word is.
    """
    key = F.concat_ws("\u0000", "lang", "word")
    bits = bitmap(rest.select((F.crc32(key) % (1 << SLOTS)).alias("slot")))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, seen = shared.value
        known = {(lang, word.encode()) for lang, word in listed}
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(counts)
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([b" ".join(r[1]).decode() for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([counts[r] for r in rows], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "size", "f"])

        def kind(lang: str, word: bytes) -> int:
            if (lang, word) in known:
                return 1
            slot = zlib.crc32(lang.encode() + b"\0" + word) % (1 << SLOTS)
            return 2 if word != b"\n" and seen[slot >> 3] >> (slot & 7) & 1 else 0

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                name = lang.as_py()
                words = [w for w in tokens(text.as_py()) if w]
                kinds = [kind(name, w) for w in words]
                for i, k in enumerate(kinds):
                    odd = k == 2
                    for j in range(i + 1, min(i + longest, len(words))):
                        if not k or not kinds[j]:
                            break
                        odd |= kinds[j] == 2
                        if odd:
                            counts[name, tuple(words[i : j + 1])] += 1
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    found = docs.select("text", "lang").mapInArrow(work, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def frequent_grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = VOCABULARY, limit: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """<lang, phrase, size, f> of all n-grams with ``least`` occurrences, and <lang, n>: all word occurrences."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words = stored(count_words(rows), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    vocabulary, rest = numbered(frequent, most)
    tables = [frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    if vocabulary:
        blocks = stored(write_numbers(rows, vocabulary), "word-numbers")
        shorter = bits = None
        for size in range(2, longest + 1):
            packing = Packing(len(vocabulary).bit_length(), size)
            found = stored(merge_grams(count_grams(blocks, packing, shorter, bits, limit), packing, vocabulary, least), f"grams-{size}")
            tables.append(found.drop("slot"))
            if size == longest or found.isEmpty():
                break
            shorter, bits = packing, bitmap(found.select("slot"))
    if not rest.isEmpty():
        tables.append(rare_grams(rows, vocabulary, rest, longest).where(F.col("f") >= least))
    return stored(reduce(DataFrame.unionByName, tables), "grams"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, most: int = VOCABULARY, limit: int = FILTER) -> DataFrame:
    """<lang, rank, phrase, a, l, r, n, score>: the first ``top`` collocations of each language of <text, lang>."""
    grams, totals = frequent_grams(docs, least, longest, most, limit)
    candidates = grams.where(F.col("size") >= 2).select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"over": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over DIV under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))
    longer = candidates.where(F.col("size") >= 3).select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
