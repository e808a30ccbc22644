"""Global order without a single-task window.

A window with no partition key runs in one task. Here Spark's own range
partitioning splits the ordered rows into bands of similar size, the banded
rows are written once (so that both readers see the same bands), and each band
starts from the totals of the bands before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BAND = "_band"


def ordered_bands(df: DataFrame, order: Sequence[Column | str], bands: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and keep the partition number as a column."""
    n = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(BAND, F.spark_partition_id()))


def prior_totals(banded: DataFrame, totals: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Per band, the sums over all earlier bands: at most one row per band and group."""
    per_band = banded.groupBy(*by, BAND).agg(*[F.sum(c).alias(c) for c in totals])
    earlier = Window.partitionBy(*by).orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    return per_band.select(
        *by, BAND, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in totals.items()]
    )


def dense_index(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    start: int = 0,
    by: Sequence[str] = (),
    bands: int | None = None,
) -> DataFrame:
    """Number the rows of each group ``start``, ``start + 1``, ... in the given order.

    Rows should be unique on the group and order columns.
    """
    banded = ordered_bands(df.withColumn("_one", F.lit(1)), [*by, *order], bands)
    before = prior_totals(banded, {"_one": "_before"}, by)
    inside = Window.partitionBy(*by, BAND).orderBy(*order)
    return (
        banded.withColumn("_inside", F.row_number().over(inside))
        .join(before, [*by, BAND])
        .withColumn(name, (F.col("_before") + F.col("_inside") - F.lit(1) + F.lit(start)).cast("int"))
        .drop("_one", BAND, "_inside", "_before")
    )
