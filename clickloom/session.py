"""Session settings and the shared folder for cut lineage and cached tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Runtime settings that the wide feature tables rely on. Feature projections have
# well over 100 columns, the default limit of whole-stage code generation. HotSpot
# does not compile methods above 8000 bytes of bytecode, so a wide projection fused
# into one method would be interpreted (measured 2-3 times slower); at this limit
# Spark falls back to generated code split into small methods.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the tables rely on, and let Python workers find this package where the driver has it, if it is not installed."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and the master is local (tests on one machine) a fresh temporary
    folder is made once and kept for the life of the session; on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clickloom-"))
    return folder or context.getCheckpointDir()


def cut_lineage(df):
    """Write ``df`` to the shared folder and go on from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, work: Callable, items: Iterable, threads: int = 8) -> list:
    """``work(item)`` for each item, in driver threads that share the session's job group; results in order.

    For jobs that are many and small each, like the rounds of fold models, whose tasks then fill the cluster together.
    """
    items = list(items)
    if len(items) < 2:
        return [work(i) for i in items]
    with ThreadPoolExecutor(min(threads, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
