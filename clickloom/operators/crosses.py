"""Second-order crosses as one sparse vector.

Numbers enter standardised. A pair of numbers is their product and has a place of its own. A category, a pair of categories, and a category with a number are
hashed into ``buckets`` places: 1, 1, and the number. So a row holds as many entries as it has inputs and pairs, not as many as
there are values, and no list of values is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BUCKETS = 1 << 16
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def scale_of(df: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each number over the training rows, in one pass; a constant has deviation 1."""
    found = df.agg(*[F.avg(c) for c in numeric], *[F.stddev_pop(c) for c in numeric]).first()
    n = len(numeric)
    return {c: (found[i] or 0.0, found[n + i] or 1.0) for i, c in enumerate(numeric)}


def _bucket(a: np.ndarray, b: np.ndarray | np.uint64, buckets: int) -> np.ndarray:
    mixed = (a * np.uint64(MIX[0])) ^ (b * np.uint64(MIX[1]))
    return (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX[0])) >> np.uint64(33)) % np.uint64(buckets)


def entries(numbers: np.ndarray, categories: np.ndarray, crossed: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """<bounds of rows, indices, values, size>: indices rise within a row, entries of one place are added, zeros left out.

    ``numbers`` are rows of standardised numbers, of which ``crossed`` take part in pairs; ``categories`` are rows of 64-bit hashes.
    """
    n, width = numbers.shape
    pairs = list(combinations(crossed, 2))
    size = width + len(pairs) + buckets
    index = [np.broadcast_to(np.arange(width + len(pairs), dtype=np.uint64), (n, width + len(pairs)))]
    left, right = (np.array([p[side] for p in pairs], dtype=np.int64) for side in (0, 1))
    value = [numbers, numbers[:, left] * numbers[:, right]]
    hashed = [_bucket(categories, np.uint64(1), buckets)]
    value.append(np.ones(categories.shape))
    for i, j in combinations(range(categories.shape[1]), 2):
        hashed.append(_bucket(categories[:, i], categories[:, j], buckets)[:, None])
        value.append(np.ones((n, 1)))
    keys = np.array(crossed, dtype=np.uint64) + np.uint64(2)
    for i in range(categories.shape[1]):
        hashed.append(_bucket(categories[:, i, None], keys[None, :], buckets))
        value.append(numbers[:, list(crossed)])
    index += [h + np.uint64(width + len(pairs)) for h in hashed]
    index, value = np.concatenate(index, axis=1), np.concatenate(value, axis=1)
    order = np.argsort(index, axis=1, kind="stable")
    index, value = np.take_along_axis(index, order, 1), np.take_along_axis(value, order, 1)
    first = np.concatenate((np.ones((n, 1), bool), index[:, 1:] != index[:, :-1]), axis=1)
    at = np.flatnonzero(first)
    sums = np.add.reduceat(value.ravel(), at) if len(at) else np.zeros(0)
    places, rows = index.ravel()[at], at // index.shape[1]
    keep = sums != 0
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows[keep], minlength=n))))
    return bounds, places[keep].astype(np.int32), sums[keep], size


def raw_inputs(numeric: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    """What :func:`read_inputs` reads: numbers, NaN as null, and 64-bit hashes of categories."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_n{i}") for i, c in enumerate(numeric)]
    return [*values, *[F.xxhash64(F.lit(c), F.col(c).cast("string")).alias(f"_c{i}") for i, c in enumerate(categorical)]]


def read_inputs(batch: pa.RecordBatch, numbers: int, categories: int, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """<standardised numbers, category hashes> of the rows of a batch; a null is the mean."""
    columns = [batch.column(f"_n{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(numbers)]
    codes = [batch.column(f"_c{i}").to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64) for i in range(categories)]
    wide = np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))
    return np.nan_to_num((wide - mean) / deviation), np.stack(codes, axis=1) if codes else np.zeros((batch.num_rows, 0), np.uint64)


def crossed_vectors(
    df: DataFrame, scale: dict[str, tuple[float, float]], categorical: Sequence[str], crossed: Sequence[str] | None = None, keep: Sequence[str] = ("id",), buckets: int = BUCKETS, name: str = "features"
) -> DataFrame:
    """<keep..., features>: the numbers of ``scale``, the categories, and the crosses of the categories and the numbers ``crossed`` (all by default). Null and NaN count as the mean."""
    numeric = list(scale)
    chosen = [numeric.index(c) for c in (numeric if crossed is None else crossed)]
    mean, deviation = np.array([scale[c][0] for c in numeric]), np.array([scale[c][1] for c in numeric])
    rows = df.select(*keep, *raw_inputs(numeric, categorical))
    schema = StructType([*[rows.schema[c] for c in keep], StructField(name, VectorUDT())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            numbers, codes = read_inputs(batch, len(numeric), len(categorical), mean, deviation)
            bounds, places, sums, size = entries(numbers, codes, chosen, buckets)
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sums))],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], vector], names=schema.names)

    return rows.mapInArrow(work, schema)
