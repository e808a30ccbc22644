"""Reading and writing tables and prediction files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import col

SMALL_INPUT = 256 * 1024 * 1024
PREDICTION_SCHEMA = "id bigint, clicked double"


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the cluster sees them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return bool(fs.exists(target))


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    """Stop before any work if an input is missing."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, path: str, small: int = SMALL_INPUT) -> DataFrame:
    """Deal the rows of a small input to all cores.

    A file with one row group is one task however many cores there are. Inputs
    above ``small`` bytes split into enough tasks on their own and are left alone.
    """
    spark = df.sparkSession
    fs, target = file_system(spark, path)
    if fs.getContentSummary(target).getLength() > small:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def key_scan(spark: SparkSession, path: str, key: str = "ID", name: str = "id") -> DataFrame:
    """The key column alone; a table without it is refused."""
    df = spark.read.parquet(path)
    if key not in df.columns:
        raise KeyError(f"column {key} is required")
    return df.select(col(key).alias(name))


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """A prediction file with a header; the schema is given, so the file is read once."""
    require(spark, [path])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of unknown types; costs one more pass than a given schema."""
    require(spark, [path])
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_predictions(df: DataFrame, path: str, key: str = "id", value: str = "clicked", ordered: bool = False) -> str:
    """Header, comma, key and value. Order is a range sort, not a single output task."""
    out = df.select(key, value)
    if ordered:
        out = out.orderBy(key)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_model_outputs(df: DataFrame, folder: str, models: Sequence[str], key: str = "id", value: str = "clicked"):
    """One prediction file per model from a long table, in one write."""
    (
        df.where(col("model").isin(*models))
        .select("model", key, value)
        .write.mode("overwrite")
        .partitionBy("model")
        .option("header", True)
        .csv(folder)
    )
    return {m: f"{folder}/model={m}" for m in models}
