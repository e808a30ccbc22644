"""Exact top-k by inner product with vector-approximation files.

Vectors become integers floor(256 x) and are packed into blocks. For each pair of a query block and a vector block the cells of every vector, a few bits
for each dimension between the block's least and largest value, are derived from the exact integers. A query block scans the cells of a
vector block with one matrix product, which bounds every score from both sides; a query then reads exact vectors in order of their
upper bounds, until its k-th score lies above the next bound. The best k of each block are merged over all blocks.

Vector blocks are dealt to slots; every query block is copied to each slot and meets the vector blocks there by an equality join: a
stated query set against all rows, in blocks; rows leave a block only as results. Memory is two blocks and a slice of their bounds.

Vectors with an integer of 2^24 or more in size go to blocks of their own, which hold the components as they are. A pair with such a block is scored without cells,
in 64-bit integers if no score can exceed them, else in Python's integers; a result beyond 64 bits is an error, as in SQL.

Defined results. Vectors that are null or hold null or non-finite components take no part. Vectors are compared with vectors of their own length. A query's own row is every row with its vec_id; other repeated rows
are ranked each. Rows with a null vec_id are candidates, not queries, after all others in ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
EVERY = 50
SCALE = 256
BITS = 7
VECTORS = 8192
QUERIES = 1024
WIDE = 256
LARGEST = 1 << 24


def integers(vectors: DataFrame) -> DataFrame:
    """<vec_id, dim, v, x> of the rows of <vec_id, embedding> that take part: integers, or the components if one is large."""
    cells = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")), x.cast("double")))
    made = vectors.select("vec_id", cells.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull()))
    wide = F.exists("x", lambda x: F.abs(x) >= LARGEST / SCALE)
    plain = F.when(~wide, F.transform("x", lambda x: F.floor(x * SCALE).cast("int")))
    return made.select("vec_id", F.size("x").alias("dim"), plain.alias("v"), F.when(wide, F.col("x")).alias("x"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """<dim, n, ids, none, v, wide>: up to ``size`` rows of equal length in one row, as bytes; ``wide`` blocks hold components, others integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, bool], tuple[list, list]] = {}

        def out(dim: int, wide: bool) -> pa.RecordBatch:
            ids, v = open_.pop((dim, wide))
            nulls = np.array([i is None for i in ids])
            plain = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            matrix = np.array(v, dtype=np.float64 if wide else np.int32).reshape(len(ids), dim)
            return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(ids), "ids": plain.tobytes(), "none": nulls.tobytes(), "v": matrix.tobytes(), "wide": wide}])

        for batch in batches:
            for i, dim, v, x in zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), batch.column("v"), batch.column("x")):
                wide = x.is_valid
                ids, kept = open_.setdefault((dim, wide), ([], []))
                ids.append(i)
                kept.append(np.asarray((x if wide else v).values, dtype=np.float64 if wide else np.int32))
                if len(ids) >= (WIDE if wide else size):
                    yield out(dim, wide)
        for key in list(open_):
            yield out(*key)

    return rows.mapInArrow(work, "dim long, n long, ids binary, none binary, v binary, wide boolean")


def whole(x: np.ndarray) -> np.ndarray:
    """Components of any finite size as Python integers floor(SCALE x); from 2^53 on a component is an integer itself."""
    return np.array([int(c) * SCALE if abs(c) >= 2**53 else math.floor(c * SCALE) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)


def exact_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, none: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """What ``block_top`` gives, for integers of any size."""
    most = lambda v: max((abs(int(v.min())), abs(int(v.max()))), default=0) if v.size else 0
    small = max(most(q), most(x), most(q) * most(x) * q.shape[1]) < 2**63
    q, x = (v.astype(np.int64 if small else object) for v in (q, x))
    for r in range(len(q)):
        scores = x @ q[r] if x.shape[1] else np.zeros(len(x), np.int64)
        rows = np.flatnonzero(none | (x_ids != q_ids[r]))
        if len(rows) > k:
            least = np.sort(scores[rows])[-k]
            rows = rows[(scores[rows] >= least).astype(bool)]
        for i in sorted(rows.tolist(), key=lambda i: (-int(scores[i]), bool(none[i]), int(x_ids[i])))[:k]:
            yield r, i, int(scores[i]), len(x)


def block_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, none: np.ndarray, k: int, bits: int = BITS, slice_: int = 256) -> Iterator[tuple[int, int, int, int]]:
    """<query row, vector row, score, vectors read> of the k best vectors of a block for each query."""
    low = x.min(axis=0).astype(np.int64) if len(x) else np.zeros(x.shape[1], np.int64)
    width = np.maximum(1, -(-(x.max(axis=0).astype(np.int64) - low + 1) // (1 << bits))) if len(x) else low
    cells = (x - low) // np.maximum(width, 1)
    cells_f = cells.astype(np.float64)
    rank = np.lexsort((x_ids, none))
    order = np.empty(len(x), np.int64)
    order[rank] = np.arange(len(x))
    for a in range(0, len(q), slice_):
        part = q[a : a + slice_].astype(np.int64)
        base = (part.astype(np.float64) * width) @ cells_f.T + (part @ low)[:, None]
        spare = width - 1
        lower = base + (np.minimum(part, 0) @ spare)[:, None]
        upper = base + (np.maximum(part, 0) @ spare)[:, None]
        for r in range(len(part)):
            others = none | (x_ids != q_ids[a + r])
            up = np.where(others, upper[r], -np.inf)
            sure = np.where(others, lower[r], -np.inf)
            count = int(others.sum())
            if not count:
                continue
            if count > k:
                least = np.partition(sure, len(sure) - k)[len(sure) - k]
                near = np.flatnonzero(up >= least)
            else:
                near = np.flatnonzero(others)
            near = near[np.argsort(-up[near], kind="stable")]
            best: list[tuple[int, int, int]] = []
            read = 0
            while read < len(near) and (len(best) < k or up[near[read]] >= best[-1][0]):
                take = near[read : read + max(64, k)]
                read += len(take)
                scores = x[take].astype(np.int64) @ part[r]
                if len(best) == k:
                    take, scores = take[scores >= best[-1][0]], scores[scores >= best[-1][0]]
                first = np.lexsort((order[take], -scores))[:k]
                best = sorted(best + [(int(scores[i]), int(order[take[i]]), int(take[i])) for i in first], key=lambda t: (-t[0], t[1]))[:k]
            for score, _, row in best:
                yield a + r, row, score, read


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, bits: int = BITS) -> DataFrame:
    """<query_id, rank, vec_id, score>: the k vectors of largest inner product, for every query row.

    Both inputs are <vec_id, embedding>. A query id given twice is searched once for each row.
    """
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = blocks(integers(vectors), VECTORS).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    q = blocks(integers(queries).where("vec_id is not null"), QUERIES)
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("q_slot")
    q = q.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.col("wide").alias("q_wide"), every)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in ("dim", "ids", "none", "v", "wide", "q_ids", "q_v", "q_wide")}
                dim = cell["dim"].as_py()
                array = lambda c, t: np.frombuffer(cell[c].as_buffer(), t)
                ids, q_ids = array("ids", np.int64), array("q_ids", np.int64)
                none = array("none", np.bool_)
                wide, q_wide = cell["wide"].as_py(), cell["q_wide"].as_py()
                v = array("v", np.float64 if wide else np.int32).reshape(len(ids), dim)
                q_v = array("q_v", np.float64 if q_wide else np.int32).reshape(len(q_ids), dim)
                if wide or q_wide:
                    found = list(exact_top(whole(q_v) if q_wide else q_v, q_ids, whole(v) if wide else v, ids, none, k))
                else:
                    found = list(block_top(q_v, q_ids, v, ids, none, k, bits))
                if found:
                    qr, xr, score, _ = (np.array(c, dtype=np.int64) for c in zip(*found))
                    names = ["query_row", "query_id", "vec_id", "score"]
                    values = [pa.array(qr), pa.array(q_ids[qr]), pa.array(ids[xr], mask=none[xr]), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(values, names=names)

    pairs = x.join(q, (x["dim"] == q["q_dim"]) & (x["slot"] == q["q_slot"])).select("dim", "ids", "none", "v", "wide", "q_ids", "q_v", "q_wide")
    best = pairs.mapInArrow(work, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
