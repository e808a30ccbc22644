"""Proportional stratified interleaving into shards, by DataFrame functions alone.

Rows of a stratum are shuffled by a seeded hash and ranked; rank r of n becomes the fraction (r - u) / n, with u in [0, 1)
fixed per stratum so that many small strata do not meet at one fraction. All rows in order of their fractions, cut into
equal runs, give shards of which every one holds each stratum in its share, to within a row. Shard sizes differ by one row at most.

Neither ranking puts a stratum or the table into one task: ranks are counted within buckets of the hash (then of the
fraction), of BUCKET_ROWS rows on average, and start from the counts of the buckets before; only those counts are put in order.

Defined results. A null stratum is one of its own; null texts count as empty; rows with equal ids are ordered by size and
checksum, so equal rows are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 16
SEED = "42"
BUCKET_ROWS = 4096
PARTS = 4294967296


def _fraction32(text: Column) -> Column:
    """The first 32 bits of an MD5 as an integer."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _earlier(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, order, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))


def interleave(docs: DataFrame, shards: int = SHARDS, stratum: str = "source", seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """<doc_id, stratum, size, text_crc32, position, shard, slot> of each row of <doc_id, text, stratum>."""
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n")).alias("stratum"), order.alias("order"), text.alias("t"))
    total = rows.count()
    buckets = -(-total // bucket_rows) or 1
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / PARTS))

    counts = rows.groupBy("stratum", "bucket").count()
    sizes = counts.groupBy("stratum").agg(F.sum("count").alias("n"))
    counts = _earlier(counts, ["stratum"], "bucket").join(sizes, "stratum")
    narrow = rows.select("doc_id", "stratum", "order", "bucket", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("text_crc32"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("order", "doc_id", "text_crc32", "size")
    ranked = narrow.withColumn("rank", F.row_number().over(inside)).join(counts, ["stratum", "bucket"])
    share = _fraction32(F.col("stratum")) / F.lit(float(PARTS))
    ranked = ranked.withColumn("fraction", (F.col("before") + F.col("rank") - share) / F.col("n"))
    ranked = ranked.withColumn("part", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1).cast("long")))
    ranked = stored(ranked.select("doc_id", "stratum", "order", "size", "text_crc32", "fraction", "part"), "fractions")

    before = _earlier(ranked.groupBy("part").count(), [], "part")
    inside = Window.partitionBy("part").orderBy("fraction", "stratum", "order", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("rank", F.row_number().over(inside)).join(before, "part")
    placed = placed.withColumn("position", F.col("before") + F.col("rank") - 1)
    placed = placed.withColumn("shard", F.expr(f"CAST(position * {shards} DIV {max(total, 1)} AS INT)"))
    start = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return placed.select("doc_id", "stratum", "size", "text_crc32", "position", "shard", (F.col("position") - start).alias("slot"))
