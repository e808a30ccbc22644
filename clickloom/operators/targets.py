"""Ordered target statistics: a category as the rate of the rows before.

Rows have a seeded order that does not depend on how they are stored. A training row's statistic is the smoothed rate of the training rows of its
value that come before it, so its own label never enters; every other row gets the rate of all training rows of its value. The running sums are built from
the sums of earlier hash buckets and the running sums within a bucket, so a value with a third of all rows is many small windows, not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import MISSING, fill_text
from ..session import cut_lineage
from .folds import SEED

PRIOR_ROWS = 10.0
#: Rows of a value in a bucket, about, from which the number of buckets follows.
BUCKET_ROWS = 10_000


def _rate(positives: Column, n: Column, prior: float, weight: float) -> Column:
    return (positives + F.lit(weight * prior)) / (n + F.lit(weight))


def ordered_statistics(
    df: DataFrame, columns: Sequence[str], label: str = "clicked", key: str = "id", seen: Column | None = None, weight: float = PRIOR_ROWS, seed: int = SEED, prefix: int | None = None
) -> DataFrame:
    """<key, column_target...>: one row for each row of ``df``, whose keys are unique; rows that are not ``seen`` (a held-out fold, later days) or have no label do not count.

    A null category is the value MISSING; a value without training rows gets the prior, the rate of all training rows (0 without any). The result does not depend on ``prefix``, the digits of a bucket.
    """
    training = F.col(label).isNotNull() if seen is None else F.coalesce(seen, F.lit(False)) & F.col(label).isNotNull()
    text = F.col(key).cast("string")
    order = F.concat(F.md5(F.concat(text, F.lit(str(seed)))), text)
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), fill_text(c, MISSING).alias("_value")) for c in columns]))
    base = df.select(key, order.alias("_order"), training.alias("_seen"), F.when(training, F.col(label).cast("long")).otherwise(F.lit(0)).alias("_y"), *[F.col(c) for c in columns])
    total, positive = base.where("_seen").agg(F.count(F.lit(1)), F.sum("_y")).first()
    prior = (positive or 0) / total if total else 0.0
    if prefix is None:
        prefix = next((d for d in range(1, 8) if 16**d * BUCKET_ROWS >= total), 8)
    long = base.select(key, "_order", "_seen", "_y", pairs).withColumn("_bucket", F.substring("_order", 1, prefix))
    value = ["_column", "_value"]
    sums = cut_lineage(long.where("_seen").groupBy(*value, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p")))
    earlier = Window.partitionBy(*value).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*value, "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_p")])
    inside = Window.partitionBy(*value, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    running = long.where("_seen").withColumns({f"{c}_inside": F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in (("_n", F.lit(1)), ("_p", F.col("_y")))})
    own = running.join(before, [*value, "_bucket"]).select(key, "_column", _rate(F.col("_p_before") + F.col("_p_inside"), F.col("_n_before") + F.col("_n_inside"), prior, weight).alias("_rate"))
    whole = sums.groupBy(*value).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    others = long.where("NOT _seen").join(whole, value, "left").select(key, "_column", _rate(F.coalesce("_p", F.lit(0)), F.coalesce("_n", F.lit(0)), prior, weight).alias("_rate"))
    wide = own.unionByName(others).groupBy(key).pivot("_column", list(columns)).agg(F.first("_rate"))
    return wide.select(key, *[F.col(c).alias(f"{c}_target") for c in columns])


def fold_statistics(df: DataFrame, columns: Sequence[str], fold: int, label: str = "clicked", key: str = "id", fold_column: str = "fold", **options) -> DataFrame:
    """The same as fold ``fold`` trains on them: its own rows are held out, so none of their labels enters any statistic."""
    return ordered_statistics(df, columns, label, key, F.col(fold_column) != fold, **options)
