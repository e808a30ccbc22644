"""Average precision, class-balanced log loss and their combined score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clip
from .ranking import BAND, ordered_bands, prior_totals

EPS = 1e-15


def _bounded(p: Column) -> Column:
    return clip(p.cast("double"), EPS, 1.0 - EPS)


def scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that can be scored: a label and a prediction, neither null nor NaN. All metrics leave the others out."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def weighted_logloss(df: DataFrame, label: str = "clicked", score: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """<by, wll>: half the mean loss of each class; a class without rows counts 0. One aggregate."""
    p, y = _bounded(F.col(score)), F.col(label)
    loss0 = F.avg(F.when(y == 0, -F.log(F.lit(1.0) - p)))
    loss1 = F.avg(F.when(y == 1, -F.log(p)))
    zero = F.lit(0.0)
    return scored(df, label, score).groupBy(*by).agg((0.5 * F.coalesce(loss0, zero) + 0.5 * F.coalesce(loss1, zero)).alias("wll"))


def score_runs(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score. Ties collapse before any ordering."""
    return (
        scored(df, label, score)
        .groupBy(*by, F.col(score).cast("double").alias("_score"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_tp"))
    )


def cumulative_counts(
    df: DataFrame, label: str = "clicked", score: str = "pred", by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    """<by, score, n, tp, cum_n, cum_tp> by descending score, ties merged."""
    return cumulative_runs(score_runs(df, label, score, by), by, bands)


def cumulative_runs(runs: DataFrame, by: Sequence[str] = (), bands: int | None = None) -> DataFrame:
    """The same from runs that are already counted."""
    order = [*[F.col(c) for c in by], F.col("_score").desc()]
    banded = ordered_bands(runs, order, bands)
    before = prior_totals(banded, {"_n": "_before_n", "_tp": "_before_tp"}, by)
    running = (
        Window.partitionBy(*by, BAND).orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        banded.withColumns({"_run_n": F.sum("_n").over(running), "_run_tp": F.sum("_tp").over(running)})
        .join(before, [*by, BAND])
        .select(
            *by,
            F.col("_score").alias("score"),
            F.col("_n").alias("n"),
            F.col("_tp").alias("tp"),
            (F.col("_before_n") + F.col("_run_n")).alias("cum_n"),
            (F.col("_before_tp") + F.col("_run_tp")).alias("cum_tp"),
        )
    )


def _precision_sum() -> Column:
    """Sum over scores of recall gained times precision; 0 when there is no positive."""
    return F.coalesce(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")), F.lit(0.0))


def average_precision(
    df: DataFrame, label: str = "clicked", score: str = "pred", by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    return cumulative_counts(df, label, score, by, bands).groupBy(*by).agg(_precision_sum().alias("ap"))


def area_under_curve(
    df: DataFrame, label: str = "clicked", score: str = "pred", by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    """<by, auc>: the share of pairs of a positive and a negative row with the positive one above, ties by half; null without both classes."""
    negatives = F.col("n") - F.col("tp")
    above = negatives * (F.col("cum_tp") - F.col("tp") / 2)
    runs = cumulative_counts(df, label, score, by, bands)
    return runs.groupBy(*by).agg(F.try_divide(F.sum(above), F.sum("tp").cast("double") * F.sum(negatives)).alias("auc"))


def competition_score(
    df: DataFrame, label: str = "clicked", score: str = "pred", by: Sequence[str] = (), bands: int | None = None
) -> DataFrame:
    """<by, ap, wll, score> with score = 0.5 * ap + 0.5 / (1 + wll).

    The log loss is summed over the same distinct-score runs as the average
    precision, so the predictions are read and shuffled once.
    """
    return score_of_runs(score_runs(df, label, score, by), by, bands)


def score_of_runs(runs: DataFrame, by: Sequence[str] = (), bands: int | None = None) -> DataFrame:
    runs = cumulative_runs(runs, by, bands)
    p = _bounded(F.col("score"))
    negatives = F.col("n") - F.col("tp")
    loss0 = F.try_divide(F.sum(negatives * -F.log(F.lit(1.0) - p)), F.sum(negatives))
    loss1 = F.try_divide(F.sum(F.col("tp") * -F.log(p)), F.sum("tp"))
    zero = F.lit(0.0)
    return (
        runs.groupBy(*by)
        .agg(
            _precision_sum().alias("ap"),
            (0.5 * F.coalesce(loss0, zero) + 0.5 * F.coalesce(loss1, zero)).alias("wll"),
        )
        .withColumn("score", 0.5 * F.col("ap") + 0.5 / (1.0 + F.col("wll")))
    )


def fold_metrics(
    df: DataFrame, label: str = "clicked", score: str = "pred", model: str = "model", fold: str = "fold"
) -> DataFrame:
    """<model, fold, ap, wll, score> per fold, plus fold 0 for all out-of-fold rows together.

    Rows are counted per distinct score and fold first; only those counts are
    taken twice, not the predictions.
    """
    by = [model, fold]
    runs = score_runs(df.withColumn(fold, F.col(fold).cast("int")), label, score, by)
    overall = runs.groupBy(model, F.lit(0).alias(fold), "_score").agg(F.sum("_n").alias("_n"), F.sum("_tp").alias("_tp"))
    return score_of_runs(runs.unionByName(overall), by)


def cv_summary(metrics: DataFrame, by: Sequence[str] = ("model",), value: str = "score", fold: str = "fold") -> DataFrame:
    """Mean and population deviation over the folds."""
    return (
        metrics.where(F.col(fold) > 0)
        .groupBy(*by)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("folds"))
    )
