"""Fold aggregation and blending of prediction tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The documented two-level blend of six prediction files.
HIERARCHY = {
    "tree": (1.0, {"tree_a": 1.0, "tree_b": 1.0, "tree_c": 1.0}),
    "deep": (2.5, {"sequence": 1.0, "crossed_early": 1.0}),
    "crossed_late": 1.5,
}


def fold_median(
    df: DataFrame,
    by: Sequence[str] = ("id", "model"),
    value: str = "pred",
    fold: str = "fold",
    folds: Sequence[int] | None = None,
) -> DataFrame:
    """Exact median over the folds of a long prediction table (one row per group and fold).

    With the ``folds`` named, each becomes one hash-aggregated double and the
    median is taken over those columns, which is faster than collecting values.
    """
    if folds is None:
        return df.groupBy(*by).agg(F.median(value).alias(value))
    names = [f"_f{k}" for k in folds]
    wide = df.groupBy(*by).agg(*[F.max(F.when(F.col(fold) == k, F.col(value))).alias(n) for k, n in zip(folds, names)])
    return wide.select(*by, median_of(names).alias(value))


def fold_mean(df: DataFrame, by: Sequence[str] = ("id", "model"), value: str = "pred") -> DataFrame:
    """Mean over the folds present; missing folds are skipped."""
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def median_of(columns: Sequence[str]) -> Column:
    """Median over fold columns of one row: no shuffle when the folds were scored side by side."""
    held = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in columns])))
    n = F.size(held)
    lower, upper = F.get(held, F.floor((n - 1) / 2).cast("int")), F.get(held, F.floor(n / 2).cast("int"))
    return (lower + upper) / 2.0


def normalise(weights: Mapping[str, float], tolerance: float = 1e-6) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("blend weights must have a positive sum")
    if abs(total - 1.0) > tolerance:
        warnings.warn(f"blend weights sum to {total}, rescaled to 1", stacklevel=2)
        return {k: w / total for k, w in weights.items()}
    return dict(weights)


def leaf_weights(tree: Mapping, share: float = 1.0) -> dict[str, float]:
    """Flatten a weight tree: every level is normalised, a leaf gets the product of its path."""
    total = sum(w[0] if isinstance(w, tuple) else w for w in tree.values())
    out: dict[str, float] = {}
    for name, w in tree.items():
        weight, children = w if isinstance(w, tuple) else (w, None)
        part = share * weight / total
        leaves = leaf_weights(children, part) if children else {name: part}
        for leaf, value in leaves.items():
            out[leaf] = out.get(leaf, 0.0) + value
    return out


def weighted_blend(
    tables: Mapping[str, DataFrame], weights: Mapping[str, float], key: str = "id", value: str = "clicked"
) -> DataFrame:
    """<key, value>: weighted sum per key over keys present in every table.

    All tables meet in one shuffle on the key, whatever their number. Keys must
    be unique per table; a repeated key stops the job. A null prediction makes the
    key's blend null. :func:`chained_blend`
    keeps the row multiplication of an inner join instead.
    """
    weights = normalise(weights)
    names = list(weights)
    stacked = reduce(
        DataFrame.unionByName,
        [
            tables[n].select(
                key,
                (F.col(value) * F.lit(weights[n])).alias("_part"),
                F.lit(1 << i).cast("bigint").alias("_bit"),
            )
            for i, n in enumerate(names)
        ],
    )
    full = (1 << len(names)) - 1
    grouped = stacked.groupBy(key).agg(
        F.sum("_part").alias(value), F.bit_or("_bit").alias("_seen"), F.count(F.lit(1)).alias("_rows"), F.count("_part").alias("_known")
    )
    complete = grouped.where(F.col(key).isNotNull() & (F.col("_seen") == full))
    checked = F.when(F.col("_rows") == len(names), F.when(F.col("_known") == len(names), F.col(value))).otherwise(
        F.raise_error(F.concat(F.lit("repeated key in a prediction table: "), F.col(key).cast("string"))).cast("double")
    )
    return complete.select(key, checked.alias(value))


def chained_blend(
    tables: Mapping[str, DataFrame], weights: Mapping[str, float], key: str = "id", value: str = "clicked"
) -> DataFrame:
    """The same blend as a chain of inner joins; repeated keys multiply rows."""
    weights = normalise(weights)
    parts = [tables[n].select(key, (F.col(value) * F.lit(w)).alias(f"_p{i}")) for i, (n, w) in enumerate(weights.items())]
    joined = reduce(lambda a, b: a.join(b, key), parts)
    return joined.select(key, reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(parts))]).alias(value))


#: Most models of one blend; their marks share a 64-bit mask.
MODELS = 60


def blend_long(predictions: DataFrame, weights: DataFrame, key: str = "id", value: str = "pred") -> DataFrame:
    """<key, clicked> from a long table <key, model, value> and a weight table <model, w>.

    A blend has few models, MODELS at most, so their weights are read once and become one
    expression; the predictions are not moved by model. Keys that lack a model's prediction are left out.
    """
    known = weights.select("model", "w").limit(MODELS + 1).collect()
    if len(known) > MODELS:
        raise ValueError(f"more than {MODELS} models in one blend")
    names = F.create_map(*[F.lit(x) for m, w in known for x in (m, float(w))])
    bits = F.create_map(*[F.lit(x) for i, (m, _) in enumerate(known) for x in (m, 1 << i)])
    rows = predictions.where(F.col(value).isNotNull()).select(
        key, (names[F.col("model")] * F.col(value)).alias("_part"), bits[F.col("model")].cast("bigint").alias("_bit")
    )
    grouped = rows.where(F.col("_bit").isNotNull()).groupBy(key).agg(F.sum("_part").alias("clicked"), F.bit_or("_bit").alias("_seen"))
    return grouped.where(F.col("_seen") == (1 << len(known)) - 1).drop("_seen")


def perf_weights(scores: DataFrame) -> DataFrame:
    """<model, w>: each model's score over the sum of scores."""
    total = scores.agg(F.sum("score")).scalar()
    return scores.select("model", (F.col("score") / total).alias("w"))


def submission_stats(df: DataFrame, value: str = "clicked") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("avg_value"),
    )


def prediction_stats(df: DataFrame, by: Sequence[str] = ("model", "fold"), value: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
