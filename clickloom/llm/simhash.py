"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most three bits, one
segment differs in at most one. Each segment is indexed by its value and by its 32 variants with one bit
left out; fingerprints meet by equality of such keys and are then verified on all bits. A variant pairs only
fingerprints that do differ in the bit left out, equal segments meet under the whole value, so a pair is not found 32 times over.

Keys with few fingerprints are joined; keys with more (up to GROUP) are searched in one task each, which returns a spanning
set of links instead of all pairs; beyond GROUP a key is refined by variants of the rest of the fingerprint, twice at most,
after which a key holds no more than 2,048 different fingerprints. No key is dropped.

Defined results. Null and empty texts have fingerprint zero, which links like any other. Equal fingerprints are one node, so
copies never make pairs. component_id is the smallest id that is not null in the component, null if there is none. Repeated
rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_row, components, stored, text_key

SHINGLE = 3
MAX_BITS = 3
SEED = 42
JOINED = 32
GROUP = 20000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; unsigned."""
    found = WORD.findall((text or "").encode().lower())
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(found) <= width:
        hashes = [digest(line, SEED)]
    else:
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    bits = np.zeros(64, dtype=np.int64)
    view = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(view), 65536):
        bits += np.unpackbits(view[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], dtype="<u8").view("<i8"))

    return compute(text)


def _bits(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def _keys(spans: list[tuple[int, int, int]], tag: Column | None = None) -> Column:
    """An array of <key, side, open> over the spans (offset, width, offset of the open part).

    A key is a span's value (side -1), or its value with one bit left out (side: that bit).
    """
    made = []
    for k, (at, width, rest) in enumerate(spans):
        value = _bits(at, width)
        for i in range(-1, width):
            masked = value if i < 0 else value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))
            key = masked + F.lit((k * 33 + i + 1) << 32)
            key = key if tag is None else F.xxhash64(tag, key)
            side = F.lit(-1) if i < 0 else _bits(at + i, 1)
            made.append(F.struct(key.alias("key"), side.cast("byte").alias("side"), F.lit(rest).cast("byte").alias("open")))
    return F.array(*made)


def _met(df: DataFrame) -> DataFrame:
    """The rows of <fp, v> whose key may join two fingerprints, with the number of the key's rows."""
    made = df.select("fp", F.col("v.key").alias("key"), F.col("v.side").alias("side"), F.col("v.open").alias("open"))
    group = Window.partitionBy("key")
    sized = made.select("*", F.count("*").over(group).alias("n"), F.min("side").over(group).alias("_low"), F.max("side").over(group).alias("_high"))
    return sized.where((F.col("n") > 1) & ((F.col("_low") == -1) | (F.col("_low") != F.col("_high")))).drop("_low", "_high")


def _refined(large: DataFrame, width: int) -> DataFrame:
    """Overfull keys split by the keys of the two halves of the part of the fingerprint that they leave open.

    That part differs in three bits at most, so one half differs in at most one.
    """
    halves = F.lit(None)
    for at in range(0, 64, 2 * width):
        spans = [(at, width, at + width), (at + width, width, at)]
        halves = F.when(F.col("open") == at, _keys(spans, F.col("key"))).otherwise(halves)
    return _met(large.select("fp", F.explode(halves).alias("v")))


def _near(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _joined(meet: DataFrame, bits: int) -> DataFrame:
    left = meet.where(F.col("side") <= 0).select("key", "side", F.col("fp").alias("a"))
    right = meet.where(F.col("side") != 0).select("key", F.col("side").alias("other"), F.col("fp").alias("b"))
    both = left.join(right, "key").where(_near(F.col("a"), F.col("b"), bits))
    return both.where(((F.col("side") == 0) & (F.col("other") == 1)) | ((F.col("side") == -1) & (F.col("a") < F.col("b")))).select("a", "b")


def spanning_links(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``bits``: each value is searched once, against those not yet reached."""
    left = np.unique(values.astype("<i8")).view("<u8")
    links, front = [], []
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
        here = front.pop()
        close = np.bitwise_count(left ^ here) <= bits
        reached = left[close]
        if len(reached):
            links += [(int(here.view("<i8")), int(x)) for x in reached.view("<i8")]
            front += list(reached)
            left = left[~close]
        elif not len(left):
            break
    return links


def links(fingerprints: DataFrame, bits: int = MAX_BITS, joined: int = JOINED, group: int = GROUP) -> DataFrame:
    """<a, b> that connect all distinct fingerprints <fp> within ``bits`` (three at most) of each other."""
    if bits > 3:
        raise ValueError("two segments find at most three differing bits")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(pdf["fp"].to_numpy(), bits), columns=["a", "b"]).astype("int64")

    def searched(meet: DataFrame) -> DataFrame:
        return meet.select("key", "fp").groupBy("key").applyInPandas(search, "a long, b long")

    first = fingerprints.select("fp", F.explode(_keys([(0, 32, 32), (32, 32, 0)])).alias("v"))
    meet = stored(_met(first), "variants")
    found = _joined(meet.where(F.col("n") <= joined), bits)
    large = meet.where(F.col("n") > joined)
    for width in (16, 8):
        found = found.unionByName(searched(large.where(F.col("n") <= group)))
        large = large.where(F.col("n") > group)
        if large.isEmpty():
            return found
        large = stored(_refined(large, width), "refined")
    return found.unionByName(searched(large))


def groups(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """<doc_id, text_key, fp, component_id>, one row per row of <doc_id, text>."""
    prints = stored(docs.select(*text_key(), fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    linked = stored(labels.join(nodes, "fp"), "linked")
    lowest = linked.groupBy("label").agg(F.min("least").alias("lowest"))
    linked = linked.join(lowest, "label").select("fp", "lowest")
    owner = nodes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))
    return prints.join(owner, "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """<doc_id, fingerprint, component_id> of each row."""
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs, width, bits).select("doc_id", shown.alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id, then the smallest text hash; of equal rows one."""
    found = groups(docs, width, bits)
    key = F.when(F.col("component_id").isNull(), F.col("fp")).otherwise(F.col("component_id"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = found.groupBy(F.col("component_id").isNull(), key).agg(F.min(own).alias("own")).select("own.doc_id", "own.text_key")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_key())
    kept = by_row(packed, chosen, "left_semi")
    first = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("row.lang", "row.source"))
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("row.*")
