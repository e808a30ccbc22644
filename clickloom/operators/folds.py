"""Fold assignment, class weights and training noise, all free of partition order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import gaussian
from ..session import cut_lineage

FOLDS = 5
SEED = 42
NOISE_SIGMA = 1e-5


def stratified_folds(
    df: DataFrame, key: str = "id", label: str = "clicked", k: int = FOLDS, seed: int = SEED, prefix: int = 3
) -> DataFrame:
    """<key, label, fold>: rows of each class dealt to folds 1..k in the order of a seeded hash.

    A window per class would be one task per class. The rank is built from two
    parts instead: the rows in earlier hash buckets (16^prefix buckets per
    class) and the rank inside the bucket. The result does not depend on ``prefix``.
    """
    hashed = df.select(key, label, F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))).alias("_hash"))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, prefix))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        hashed.groupBy(label, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(label, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_inside", F.row_number().over(inside))
        .join(before, [label, "_bucket"])
        .select(key, label, ((F.col("_before") + F.col("_inside") - 1) % k + 1).cast("int").alias("fold"))
    )


def fold_cuts(
    df: DataFrame, key: str = "id", label: str = "clicked", k: int = FOLDS, seed: int = SEED, prefix: int = 3
) -> list[tuple]:
    """``(label, fold, last hash)`` for folds 1..k-1 of each class: where the seeded hash order is cut.

    Each class is cut into k runs of equal length (the first ones take the odd
    rows, as ``ntile`` does). Rows per hash bucket are counted first; only the
    buckets that hold a cut are ranked. What comes back to the driver is
    (k - 1) rows per class.
    """
    hashed = df.where(F.col(label).isNotNull()).select(label, _order_key(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, prefix))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        hashed.groupBy(label, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(label)))
    )
    j = F.explode(F.sequence(F.lit(1), F.lit(k - 1)))
    size, odd = F.floor(F.col("_total") / k), F.col("_total") % k
    wanted = (
        buckets.withColumn("fold", j)
        .withColumn("_rank", F.col("fold") * size + F.least(F.col("fold").cast("bigint"), odd) - F.col("_before"))
        .where((F.col("_rank") > 0) & (F.col("_rank") <= F.col("_n")))
        .select(label, "_bucket", "fold", "_rank")
    )
    # (k - 1) rows per class: small by construction, so the full table meets them by broadcast.
    cut = cut_lineage(wanted)
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash")
    ranked = hashed.join(F.broadcast(cut.select(label, "_bucket").distinct()), [label, "_bucket"]).withColumn(
        "_at", F.row_number().over(inside)
    )
    rows = ranked.join(F.broadcast(cut), [label, "_bucket"]).where(F.col("_at") == F.col("_rank"))
    return [tuple(r) for r in rows.select(label, "fold", "_hash").collect()]


def _order_key(key: str, seed: int):
    text = F.col(key).cast("string")
    return F.concat(F.md5(F.concat(text, F.lit(str(seed)))), text)


def assign_folds(
    df: DataFrame, cuts: Sequence[tuple], key: str = "id", label: str = "clicked", k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` from the cuts: row-local, so wide rows are not shuffled. A row without a label belongs to no fold: null."""
    order = _order_key(key, seed)
    fold = F.when(F.col(label).isNotNull(), F.lit(k))
    for value, number, last in sorted(cuts, key=lambda c: (str(c[0]), c[1]), reverse=True):
        fold = F.when((F.col(label) == F.lit(value)) & (order <= F.lit(last)), F.lit(number)).otherwise(fold)
    return df.withColumn("fold", fold)


def class_weights(df: DataFrame, label: str = "clicked", mode: str = "ratio") -> DataFrame:
    """<label, n, weight>: ``ratio`` gives positives negatives/positives, ``balanced``
    gives every class total / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    negatives = F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0))
    if mode == "ratio":
        other = counts.agg(negatives).scalar()
        weight = F.when(F.col(label) == 1, other / F.col("n")).otherwise(F.lit(1.0))
    elif mode == "balanced":
        share = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
        weight = share / F.col("n")
    else:
        raise ValueError(f"unknown class weight mode: {mode}")
    return counts.select(label, "n", weight.cast("double").alias("weight"))


#: Most classes of a label whose weights become an expression.
CLASSES = 100


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "clicked", name: str = "weight") -> DataFrame:
    """Attach the weight of the row's class; a row whose label is null or unknown gets null.

    Labels have few values, CLASSES at most: their weights are read once and become one expression, so that rows
    are not moved by label.
    """
    known = weights.select(label, "weight").limit(CLASSES + 1).collect()
    if len(known) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    weight = F.lit(None).cast("double")
    for value, w in known:
        if value is not None:
            weight = F.when(F.col(label) == F.lit(value), F.lit(w)).otherwise(weight)
    return df.withColumn(name, weight)


def fixed_class_weight(df: DataFrame, positive: float = 51.4, label: str = "clicked", name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(F.lit(1.0)))


def inject_noise(
    df: DataFrame, columns: Sequence[str], fold: int, key: str = "id", seed: int = SEED, sigma: float = NOISE_SIGMA,
    where: Column | None = None,
) -> DataFrame:
    """Add seeded normal noise to numeric training columns; of rows not ``where`` the values stay."""

    def noised(c: str) -> Column:
        value = F.col(c).cast("double")
        moved = value + gaussian(key, c, seed + fold, sigma=sigma)
        return moved if where is None else F.when(where, moved).otherwise(value)

    return df.withColumns({c: noised(c) for c in columns}) if columns else df


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal_draws(salt: np.ndarray, n: int) -> np.ndarray:
    """``n`` normal draws for each 64-bit salt (Box-Muller, as in :func:`inject_noise`), for whole batches: a projection with a hundred draws grows beyond what Java compiles."""
    places = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    uniform = ((_mixed(salt.astype(np.uint64)[:, None] + places) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(uniform[:, :n])) * np.cos(2 * np.pi * uniform[:, n:])
