"""Stored models and tables, and the list of runs that made them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def save_model(model: MLWritable, root: str, name: str, fold: int) -> str:
    path = f"{root}/{name}_fold{fold}"
    model.write().overwrite().save(path)
    return path


def load_fold_models(paths: dict[int, str]) -> dict[int, PipelineModel]:
    return {fold: PipelineModel.load(path) for fold, path in paths.items()}


def save_table(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a vocabulary, frequency or metric table and go on from the stored copy."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def record_run(spark: SparkSession, root: str, name: str, path: str) -> None:
    """Append <name, path, created_at> to the run table."""
    row = spark.range(1).select(
        F.lit(name).alias("name"), F.lit(path).alias("path"), F.current_timestamp().alias("created_at")
    )
    row.write.mode("append").parquet(f"{root}/runs")


def record_fold(spark: SparkSession, root: str, name: str, fold: int, path: str, facts: Mapping[str, float]) -> None:
    """Append a row for a fold model to the run table, in a part of its own, so that folds that end together do not meet."""
    known = [F.lit(float(v)).alias(k) for k, v in facts.items()]
    row = spark.range(1).select(F.lit(path).alias("path"), *known, F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(f"{root}/runs/name={name}/fold={fold}")


def fold_runs(spark: SparkSession, root: str, name: str) -> dict[int, Row]:
    """The newest run of each fold of a learner: what is trained already. One small row for each fold."""
    place = f"{root}/runs/name={name}"
    if not exists(spark, place):
        return {}
    runs = spark.read.option("basePath", f"{root}/runs").parquet(place)
    newest = runs.groupBy("fold").agg(F.max_by(F.struct(*runs.columns), "created_at").alias("run"))
    return {r.fold: r.run for r in newest.collect()}


def latest(runs: DataFrame, by: str = "name", path: str = "path", created: str = "created_at") -> DataFrame:
    """The newest path per name."""
    return runs.groupBy(by).agg(F.max_by(path, F.struct(created, path)).alias(path))
