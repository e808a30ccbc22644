"""Out-of-core feature runs: new files are read, transformed and appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.encode import apply_frequency


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is given, nothing is inferred."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_frequencies(stream: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stream-static join with a stored frequency table; null and unseen values get 0."""
    return apply_frequency(stream, table, columns)


def run_once(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, then stop. Started again with the same
    checkpoint it goes on after the last finished batch, so a lost driver loses no file."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(output)
