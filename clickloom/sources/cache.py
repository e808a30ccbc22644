"""Keyed Parquet cache for engineered features, of a whole input or file by file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists, file_system

CACHE_PARTS = ("feature_engineering", "features", "training")


def input_stamp(spark: SparkSession, path: str) -> dict:
    """What identifies the input: path, bytes, files and last change."""
    fs, target = file_system(spark, path)
    summary = fs.getContentSummary(target)
    return {
        "path": path,
        "bytes": int(summary.getLength()),
        "files": int(summary.getFileCount()),
        "changed": max([int(fs.getFileStatus(target).getModificationTime()), *[int(f.getModificationTime()) for f in fs.listStatus(target)]]),
    }


def cache_key(config: Mapping, stamps: Sequence[Mapping] = ()) -> str:
    """First 8 hex digits of the MD5 over the sorted JSON of settings and inputs."""
    parts = {name: config.get(name, {}) for name in CACHE_PARTS}
    parts["inputs"] = list(stamps)
    return hashlib.md5(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:8]


def feature_cache(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    config: Mapping,
    inputs: Sequence[str],
    root: str,
    data_type: str = "train",
    force: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read the cached features, or build and write them first.

    A table counts as present only with its success marker, so a job that died
    half way is written again. A table partitioned by fold lets every fold's
    training and scoring read its own files only.
    """
    key = cache_key(config, [input_stamp(spark, p) for p in inputs])
    path = f"{root}/{data_type}_fe_{key}.parquet"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


PART = "part"


def part_cache(spark: SparkSession, build: Callable[[DataFrame], DataFrame], config: Mapping, path: str, root: str) -> DataFrame:
    """Row-local features of an input of many files, kept for each file: only files that are new or changed are computed.

    ``build`` gets rows with a column ``part``, made of a file's path, size and time, and must keep it. Parts are written by dynamic partition overwrite and
    then listed in a manifest <part, file, n>, so a job that died half way writes the same parts again. Parts of files that are gone are not read.
    """
    place = f"{root}/parts_{cache_key(config)}"
    source = spark.read.parquet(path)
    stamp = F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string"))
    part = F.substring(F.md5(stamp), 1, 16).alias(PART)
    present = source.groupBy(part, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    missing = present
    if exists(spark, f"{place}/manifest"):
        missing = present.join(spark.read.parquet(f"{place}/manifest").select(PART), PART, "left_anti")
    new = missing.collect()  # a row for each file that is new
    if new:
        rows = spark.read.schema(source.schema).parquet(*[unquote(r.file) for r in new])
        made = build(rows.select("*", part))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{place}/data")
        spark.createDataFrame(new, present.schema).write.mode("append").parquet(f"{place}/manifest")
    return spark.read.parquet(f"{place}/data").join(present.select(PART), PART, "left_semi").drop(PART)
