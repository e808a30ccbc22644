"""MLlib learners: the three boosted-tree set-ups, the crossed linear model, scoring and stacking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fill_number, fill_text
from ..session import side_by_side
from .folds import FOLDS, SEED

# Depth, learning rate, rounds, subsampling, minimum child size and
# bins of the three set-ups. MLlib has no L1/L2 leaf penalty, and its minimum gain
# is a mean per row, so a minimum total loss of 0.1 per split is 0 here.
BOOSTED = {
    "a": {
        "maxDepth": 10, "stepSize": 0.01, "maxIter": 2500, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8", "minInstancesPerNode": 10, "maxBins": 256,
    },
    "b": {"maxDepth": 6, "stepSize": 0.03, "maxIter": 4000},
    "c": {"maxDepth": 10, "stepSize": 0.03, "maxIter": 4000},
}
# Step and weight decay of the factor machine, as published for the cross network; with MLlib's step of 1 its loss on many inputs ends above that of a constant.
FACTORED = {"stepSize": 0.001, "regParam": 1e-5}
CLASS_WEIGHTING = {"a": "ratio", "b": "balanced", "c": 51.4}


def boosted_trees(
    setup: str = "a", weight: str | None = None, validation: str | None = None, **overrides
) -> GBTClassifier:
    """A boosted-tree estimator; ``overrides`` replaces single parameters.

    MLlib stops at the first round that gains less than ``validationTol`` and has no patience setting; at 0 it
    stops only when the validation loss gets worse.

    ``validation`` names a boolean column; its rows only decide when to stop.
    """
    params = dict(featuresCol="features", labelCol="clicked", seed=SEED, checkpointInterval=10, validationTol=0.0)
    params.update(BOOSTED[setup])
    if weight:
        params["weightCol"] = weight
    if validation:
        params["validationIndicatorCol"] = validation
    params.update(overrides)
    return GBTClassifier(**params)


def by_cardinality(df: DataFrame, columns: Sequence[str], limit: int = 256) -> tuple[list[str], list[str]]:
    """Columns with clearly fewer values than ``limit``, and the others, in one pass with bounded sketches.

    Trees split on the first kind natively; the second kind should be frequency
    encoded, because its value list would have to fit one machine.
    """
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] * 1.2 < limit]
    return few, [c for c in columns if c not in few]


def native_categories(columns: Sequence[str]) -> list[StringIndexer]:
    """Text columns of few values (see :func:`by_cardinality`) to nominal indices the trees
    split on directly; unseen values get their own index."""
    names = list(columns)
    return [
        StringIndexer(
            inputCols=names,
            outputCols=[f"{c}_idx" for c in names],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        )
    ]


def target_encoding(columns: Sequence[str], label: str = "clicked") -> TargetEncoder:
    """Mean label per category index, smoothed; fit it inside a training fold only."""
    return TargetEncoder(
        inputCols=list(columns), outputCols=[f"{c}_target" for c in columns], labelCol=label,
        handleInvalid="keep", smoothing=10.0,
    )


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep")


def filled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Numbers without null or NaN, categories as text with the missing marker."""
    return df.withColumns(
        {**{c: fill_number(c) for c in numeric}, **{c: fill_text(c) for c in categorical}}
    )


def tree_pipeline(
    numeric: Sequence[str], categorical: Sequence[str] = (), setup: str = "a", weight: str | None = None, **overrides
) -> Pipeline:
    stages = native_categories(categorical) if categorical else []
    inputs = list(numeric) + [f"{c}_idx" for c in categorical]
    return Pipeline(stages=[*stages, assembler(inputs), boosted_trees(setup, weight, **overrides)])


def one_hot(categorical: Sequence[str]) -> list:
    """Text columns to 0/1 vectors, an unseen value as a value of its own; no stage without columns."""
    if not categorical:
        return []
    encoder = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=False)
    return [*native_categories(categorical), encoder]


def crossed_linear(numeric: Sequence[str], degree: int = 2, categorical: Sequence[str] = (), **params) -> Pipeline:
    """Explicit products up to ``degree``, of numbers and categories, followed by logistic regression."""
    return Pipeline(
        stages=[
            *one_hot(categorical),
            assembler([*numeric, *[f"{c}_hot" for c in categorical]], "raw"),
            PolynomialExpansion(degree=degree, inputCol="raw", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="clicked", **params),
        ]
    )


def factor_machine(numeric: Sequence[str], categorical: Sequence[str] = (), **params) -> Pipeline:
    """Second-order crosses through factor vectors."""
    inputs = assembler([*numeric, *[f"{c}_hot" for c in categorical]])
    return Pipeline(stages=[*one_hot(categorical), inputs, factor_learner(**params)])


def factor_learner(**params) -> FMClassifier:
    """The factor machine alone, for inputs that are vectors already."""
    return FMClassifier(featuresCol="features", labelCol="clicked", seed=SEED, **{**FACTORED, **params})


def positive_probability(scored: DataFrame, name: str = "pred") -> DataFrame:
    drop = [c for c in ("rawPrediction", "prediction") if c in scored.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", *drop)


def score(model: Model, df: DataFrame, key: str = "id", name: str = "pred", keep: Sequence[str] = ()) -> DataFrame:
    """<key, keep..., pred> from one fitted model."""
    return positive_probability(model.transform(df), name).select(key, *keep, name)


def fit_folds(
    df: DataFrame, estimator: Estimator, folds: int = FOLDS, fold: str = "fold", validation: str | None = None,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None,
) -> dict[int, PipelineModel]:
    """One model per fold, trained on the other folds, all folds side by side. ``df`` should be a stored table.

    ``prepare(df, k)`` gives the rows as fold k trains on them (weights, noise; see ``training.fold_rows``). With
    ``validation`` the held-out fold stays in the input, marked in that column, for learners that stop early on it.
    """
    def fit(k: int) -> PipelineModel:
        rows = prepare(df, k) if prepare else df
        held = F.col(fold) == k
        return estimator.fit(rows.withColumn(validation, held) if validation else rows.where(~held))

    numbers = range(1, folds + 1)
    return dict(zip(numbers, side_by_side(df.sparkSession, fit, numbers)))


def out_of_fold(
    df: DataFrame, models: Mapping[int, Model], name: str, key: str = "id", label: str = "clicked", fold: str = "fold"
) -> DataFrame:
    """<key, label, fold, model, pred>: each row scored by the model that did not see it."""
    parts = [score(m, df.where(F.col(fold) == k), key, keep=(label, fold)) for k, m in models.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit(name))


def fold_score(df: DataFrame, models: Mapping[int, Model], name: str, key: str = "id") -> DataFrame:
    """<key, model, fold, pred>: every row scored by every fold model.

    The models are applied side by side to one scan, then the fold columns are
    turned into rows; the table is not read once per fold.
    """
    wide = fold_score_wide(df, models, key)
    pairs = F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"pred_{k}").alias("pred")) for k in models])
    return wide.select(key, F.lit(name).alias("model"), F.inline(pairs))


def fold_score_wide(df: DataFrame, models: Mapping[int, Model], key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """<key, keep..., pred_1, pred_2, ...>: fold predictions as columns, without a shuffle."""
    base = df.columns
    done: list[str] = []
    for k, model in models.items():
        df = positive_probability(model.transform(df), f"pred_{k}").select(*base, *done, f"pred_{k}")
        done.append(f"pred_{k}")
    return df.select(key, *keep, *done)


def stack(oof: DataFrame, test: DataFrame, models: Sequence[str], key: str = "id", label: str = "clicked") -> DataFrame:
    """Logistic regression over the models' out-of-fold columns, applied to the test columns."""
    names = list(models)
    meta = Pipeline(stages=[assembler(names), LogisticRegression(featuresCol="features", labelCol=label)])
    wide_oof = oof.groupBy(key, label).pivot("model", names).agg(F.first("pred"))
    wide_test = test.groupBy(key).pivot("model", names).agg(F.first("pred"))
    return score(meta.fit(wide_oof.na.drop(subset=names)), wide_test.na.drop(subset=names), key, "clicked")
