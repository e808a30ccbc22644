"""Shared pieces: words, single evaluation inside expressions, written tables, star-joined components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from the files.

    The copy outlives executors, and its size is known to the planner, which then
    broadcasts it in a join only when the files are below the broadcast threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart: the id and a hash of the text (null and empty texts differ)."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit("")), F.col(text).isNull()).alias("text_key")]


def by_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (null equals null) and text_key; the right side's copies of both are dropped."""
    right = right.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    return left.join(right, same, how).drop("_doc_id", "_text_key")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: <node, label>, label the smallest node.

    ``edges`` has two long columns a and b, without nulls; nodes with no edge to another node
    do not appear. Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Each step is an aggregation with
    partial sums and an equality join, so a node with very many neighbours is split by
    adaptive execution. Rounds grow with the logarithm of the longest chain. Every round is
    written with a reliable checkpoint; the driver sees one count and one checksum.
    """
    directed = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = cut_lineage(edges.where(F.col("a") != F.col("b")).select(*directed).distinct())
    seen = None
    while True:
        mark = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())
        if mark == seen or mark[0] == 0:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        seen = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.where("a != b").unionByName(low.select("a", F.col("low").alias("b")))
        current = cut_lineage(small.distinct())
