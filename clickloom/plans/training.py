"""Cross-validated training, scoring and blending over stored feature tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import TWO_32, keyed_hash32
from ..operators import ensemble, learners, metrics
from ..operators.folds import FOLDS, SEED, assign_folds, class_weights, fixed_class_weight, fold_cuts, inject_noise, with_class_weight
from ..session import cut_lineage, side_by_side
from ..sources import artefacts


def with_folds(df: DataFrame, key: str = "id", label: str = "clicked", k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Attach stratified folds: the cuts come from key and label alone, wide rows stay where they are."""
    return assign_folds(df, fold_cuts(df, key, label, k, seed), key, label, k, seed)


def fold_rows(
    noisy: Sequence[str] = (), weighting: str | float | None = None, key: str = "id", label: str = "clicked", fold: str = "fold", weigh_held: bool = True
) -> Callable[[DataFrame, int], DataFrame]:
    """How a fold prepares its rows: class weights counted on its training rows, noise on those rows only.

    ``weighting`` is a mode of ``folds.class_weights``, a fixed weight of the positive class, or None. Without ``weigh_held`` the held-out rows weigh 1.
    """

    def prepare(df: DataFrame, k: int) -> DataFrame:
        seen = F.col(fold) != k
        if isinstance(weighting, str):
            df = with_class_weight(df, class_weights(df.where(seen), label, weighting), label)
        elif weighting is not None:
            df = fixed_class_weight(df, weighting, label)
        if weighting is not None and not weigh_held:
            df = df.withColumn("weight", F.when(seen, F.col("weight")).otherwise(F.lit(1.0)))
        return inject_noise(df, noisy, k, key, where=seen)

    return prepare


def labelled_sample(df: DataFrame, most: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """All rows of a stored table, or about ``most`` of them, chosen by a seeded hash of the key: a bound on what a learner is fitted to."""
    n = df.count()
    return df if n <= most else df.where(keyed_hash32(key, "sample", seed) < F.lit(int(TWO_32 * most / n)))


def train_folds(
    spark: SparkSession, root: str, name: str, fit: Callable[[int, str], Mapping[str, float]], folds: int = FOLDS
) -> dict[int, Row]:
    """Train the fold models that ``root`` does not hold yet, side by side; <fold: run row with path and facts>.

    ``fit(k, path)`` writes the model of fold k to the path. Each model is recorded as it ends, so a second start goes on where the first one stopped.
    """
    known = artefacts.fold_runs(spark, root, name)

    def one(k: int) -> None:
        path = f"{root}/models/{name}_fold{k}"
        artefacts.record_fold(spark, root, name, k, path, fit(k, path))

    side_by_side(spark, one, [k for k in range(1, folds + 1) if k not in known])
    return artefacts.fold_runs(spark, root, name)


def train_folds_at_once(
    spark: SparkSession, root: str, name: str, fit: Callable[[list[int]], Mapping[int, tuple[Callable[[str], None], Mapping[str, float]]]], folds: int = FOLDS
) -> dict[int, Row]:
    """As :func:`train_folds` for a learner that fits folds in the same passes: ``fit(numbers)`` gives <how to write the model, facts> of each fold that is not there yet."""
    known = artefacts.fold_runs(spark, root, name)
    missing = [k for k in range(1, folds + 1) if k not in known]
    for k, (write, facts) in (fit(missing) if missing else {}).items():
        path = f"{root}/models/{name}_fold{k}"
        write(path)
        artefacts.record_fold(spark, root, name, k, path, facts)
    return artefacts.fold_runs(spark, root, name) if missing else known


def cross_validate(
    train: DataFrame, estimators: Mapping[str, Estimator], folds: int = FOLDS, key: str = "id", label: str = "clicked",
    prepare: Mapping[str, Callable[[DataFrame, int], DataFrame]] | None = None, validation: Mapping[str, str] | None = None,
) -> tuple[dict, DataFrame, DataFrame]:
    """Fold models, out-of-fold predictions and their metrics for each estimator.

    ``train`` is a stored table with a ``fold`` column; nothing upstream of it
    is computed again per fold. ``prepare`` and ``validation`` are per estimator, as in ``learners.fit_folds``; rows are
    scored as they are stored. The out-of-fold predictions feed metrics, weights
    and stacking, so they are written once instead of being scored for each.
    """
    prepare, validation = prepare or {}, validation or {}
    models = {n: learners.fit_folds(train, e, folds, validation=validation.get(n), prepare=prepare.get(n)) for n, e in estimators.items()}
    parts = [learners.out_of_fold(train, m, name, key, label) for name, m in models.items()]
    oof = cut_lineage(reduce(DataFrame.unionByName, parts))
    return models, oof, metrics.fold_metrics(oof, label)


def joined_folds(wide: Mapping[str, DataFrame], key: str = "id", how: str = "median") -> DataFrame:
    """<key, model, pred>: the fold predictions ``pred_1``, ``pred_2``, ... of each learner joined by median (or mean), without a shuffle."""
    parts = []
    for name, df in wide.items():
        cols = [c for c in df.columns if c.startswith("pred_")]
        joined = ensemble.median_of(cols) if how == "median" else reduce(lambda a, b: a + b, map(F.col, cols)) / len(cols)
        parts.append(df.select(key, F.lit(name).alias("model"), joined.alias("pred")))
    return reduce(DataFrame.unionByName, parts)


def blend_folds(wide: Mapping[str, DataFrame], weights: DataFrame, key: str = "id", how: str = "median") -> DataFrame:
    """<key, clicked>: the folds of each learner joined, then the learners blended by weight."""
    return ensemble.blend_long(joined_folds(wide, key, how), weights, key)


def score_and_blend(
    test: DataFrame, models: Mapping[str, Mapping], weights: DataFrame, key: str = "id", how: str = "median"
) -> DataFrame:
    """<key, clicked>: folds of each model joined by median (or mean), then blended by weight.

    The fold models of one learner score side by side, so the fold step needs no shuffle.
    """
    return blend_folds({name: learners.fold_score_wide(test, each, key) for name, each in models.items()}, weights, key, how)
