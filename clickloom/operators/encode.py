"""Frequency, label and vocabulary encodings as tables and joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import items
from ..functions.values import MISSING, fill_text
from ..session import cut_lineage
from .lookup import BROADCAST_BYTES, fits, lookup_sides
from .ranking import dense_index


# -- frequency ---------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a group of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """<column, value, freq> for several columns in one pass over the data, stored.

    Nulls count towards the total but get no entry of their own.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = cut_lineage(
        df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.where(F.col("column") == columns[0]).agg(F.sum("n")).scalar()
    return counts.where(F.col("value").isNotNull()).select("column", "value", (F.col("n") / total).alias("freq"))


def apply_frequency(
    df: DataFrame, table: DataFrame, columns: Sequence[str], suffix: str = "_freq", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``<column>_freq`` from a stored table; null and unseen values get 0."""
    for c, side in lookup_sides(table, columns, limit):
        side = side.select(F.col("value").alias("_value"), F.col("freq").alias("_freq"))
        df = (
            df.join(side, df[c].cast("string") == F.col("_value"), "left")
            .withColumn(c + suffix, F.coalesce("_freq", F.lit(0.0)))
            .drop("_value", "_freq")
        )
    return df


def freq_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_frequency(df, frequency_table(df, columns), columns)


# -- labels ------------------------------------------------------------------


def label_table(frames: Sequence[DataFrame], columns: Sequence[str], unknown: str | None = "UNK") -> DataFrame:
    """<column, value, code> fitted on the union of all frames, each column in text order from 0; stored.

    All columns are stacked, so every frame is read once. With ``unknown`` nulls
    take part under that marker; without, they get no entry.
    """

    def value(c: str):
        return F.col(c).cast("string") if unknown is None else fill_text(c, unknown)

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    union = reduce(DataFrame.unionByName, [f.select(F.inline(pairs)) for f in frames])
    found = union.where(F.col("value").isNotNull()).distinct()
    return cut_lineage(dense_index(found, ["value"], "code", by=["column"]))


def apply_labels(
    df: DataFrame,
    table: DataFrame,
    columns: Sequence[str],
    unknown: str = "UNK",
    suffix: str = "_code",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``<column>_code`` from a stored table; values outside it get null."""
    for c, side in lookup_sides(table, columns, limit):
        side = side.select(F.col("value").alias("_value"), F.col("code").alias(c + suffix))
        df = df.join(side, fill_text(c, unknown) == F.col("_value"), "left").drop("_value")
    return df


def category_codes(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Sorted non-null values to 0..n-1, null to n."""
    table = label_table([df], columns, unknown=None)
    coded = apply_labels(df, table, columns, MISSING, suffix)
    sizes = {c: table.where(F.col("column") == c).agg(F.count(F.lit(1))).scalar().cast("int") for c in columns}
    return coded.withColumns({c + suffix: F.coalesce(c + suffix, n) for c, n in sizes.items()})


# -- sequence vocabulary -------------------------------------------------------


def distinct_items(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Every item that occurs in the non-empty sequences, once.

    Empty sequences leave through the explode; a filter would be pushed below
    the column's own expression and compute it a second time.
    """
    held = items(F.nullif(F.col(seq), F.lit("")))
    return df.select(F.explode(F.array_distinct(held)).alias("item")).distinct()


def seq_vocabulary(
    frames: Sequence[DataFrame], seq: str = "seq", candidate: str | None = None, legacy: bool = False
) -> DataFrame:
    """<item, idx> over the items of all frames and their candidate ids, in text order.

    Index 0 means padding or unknown, so real items start at 1. ``legacy=True``
    puts the text ``0`` into the list and counts from 0 in plain text order.
    """
    parts = [distinct_items(f, seq) for f in frames]
    if candidate:
        parts += [
            f.where(F.col(candidate).isNotNull()).select(F.col(candidate).cast("string").alias("item")) for f in frames
        ]
    return item_vocabulary(reduce(DataFrame.unionByName, parts), legacy)


def item_vocabulary(found: DataFrame, legacy: bool = False) -> DataFrame:
    """<item, idx> of <item>, repeated or not, numbered as :func:`seq_vocabulary` does."""
    found = found.distinct()
    if not legacy:
        return dense_index(found, ["item"], "idx", start=1)
    zero = found.sparkSession.range(1).select(F.lit("0").alias("item"))
    return dense_index(found.unionByName(zero).distinct(), ["item"], "idx")


def seq_encode_join(df: DataFrame, vocabulary: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """<key, codes> through a join; for vocabularies of any size.

    Unknown items become 0 and a missing or empty sequence becomes ``[0]``.
    """
    # rows may share a key: they are told apart by their sequence, and equal rows are counted; a row number would change if a stage were run again
    told = df.groupBy(key, F.col(seq).alias("_seq")).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    told = told.withColumn("_row", F.xxhash64(F.col("_seq"), F.col("_seq").isNull()))
    exploded = told.select(key, "_row", "_copies", F.posexplode_outer(items(F.nullif(F.col("_seq"), F.lit("")))).alias("pos", "item"))
    coded = exploded.join(vocabulary.select("item", "idx"), "item", "left")
    pair = F.struct("pos", F.coalesce("idx", F.lit(0)).alias("idx"))
    ordered = F.array_sort(F.collect_list(pair))
    whole = coded.groupBy(key, "_row", "_copies").agg(F.transform(ordered, lambda x: x["idx"]).alias("codes"))
    return whole.select(key, F.explode(F.array_repeat("codes", F.col("_copies"))).alias("codes"))


class Codes:
    """Codes of items, looked up in a dictionary that each Python worker makes once."""

    def __init__(self, words: pa.Array, index: pa.Array):
        self.words, self.index, self.known = words, index, None

    def __getstate__(self) -> tuple:
        return self.words, self.index, None

    def __setstate__(self, state: tuple) -> None:
        self.words, self.index, self.known = state

    def of(self, found: pa.Array) -> np.ndarray:
        """The code of each item, 0 for unknown ones; only the distinct items of a batch are looked up."""
        if self.known is None:
            self.known = dict(zip(self.words.to_pylist(), self.index.to_pylist()))
        coded = found.dictionary_encode()
        of_word = np.array([self.known.get(w, 0) for w in coded.dictionary.to_pylist()] + [0], dtype=np.int32)
        return of_word[pc.fill_null(coded.indices, len(of_word) - 1).to_numpy(zero_copy_only=False)]


def lookup_function(vocabulary: DataFrame, limit: int = BROADCAST_BYTES):
    """An Arrow function text -> codes with the vocabulary held as a dictionary in each worker.

    The vocabulary is measured before it is read; :func:`seq_encode_join` takes any size.

    Splitting and lookup run on whole Arrow columns; no Python loop over rows.
    """
    if not fits(vocabulary, "item", limit):
        raise ValueError(f"vocabulary above {limit} bytes: use seq_encode_join")
    table = vocabulary.select("item", "idx").toArrow().combine_chunks()
    shared = vocabulary.sparkSession.sparkContext.broadcast(Codes(table.column("item").combine_chunks().cast(pa.string()), table.column("idx").combine_chunks().cast(pa.int32())))

    def encode(seq: pa.Array) -> pa.Array:
        filled = pc.fill_null(seq, "")
        lists = pc.split_pattern(filled, ",")
        codes = shared.value.of(lists.flatten().cast(pa.string()))
        # A missing or empty sequence is one unknown item, even where the vocabulary holds the empty text.
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        codes[starts[pc.equal(filled, "").to_numpy(zero_copy_only=False)]] = 0
        return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), pa.array(codes))

    return F.arrow_udf(encode, "array<int>")


def seq_encode(
    df: DataFrame, vocabulary: DataFrame, key: str = "id", seq: str = "seq", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """<key, codes>. A vocabulary measured at or below ``limit`` bytes is sent to the tasks
    and the rows are not shuffled; a larger one goes through :func:`seq_encode_join`."""
    if not fits(vocabulary, "item", limit):
        return seq_encode_join(df, vocabulary, key, seq)
    return df.select(key, lookup_function(vocabulary, limit)(F.col(seq)).alias("codes"))
