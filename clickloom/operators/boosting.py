"""Boosted trees with leaf penalties, patience and the best round, one task for each fold model.

Spark finds the cuts of every number (quantiles over all training rows), turns rows into bins, draws the noise and chooses the labelled rows, ROWS at most,
that a fold model is fitted to; a task then grows that model's trees over the bins of its rows, and the folds run side by side. Trees are rows of a
table, and any number of rows is scored against them in parallel. MLlib's learner has no leaf penalties, no patience and no column sampling by level, and needs two stages for
each level of each tree, however few rows there are.

A set-up with ``symmetric`` trees makes one cut for all nodes of a level. Categories (indices) are ordered by their smoothed rate on the training rows of the fold, so a cut is a set of
categories. A round's gradient and curvature are those of the weighted log loss; a leaf is worth -soft(G, l1) / (H + l2), within ``step`` if it is set, times ``rate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .folds import NOISE_SIGMA, SEED, normal_draws

#: Labelled rows, about, that a fold model is fitted to and watched on; more are sampled by a seeded hash.
ROWS = 200_000
# The three set-ups. ``l1`` and ``l2`` penalise leaves, ``gamma`` is the least gain of a cut, ``child`` the least curvature of a node, ``rows``, ``columns`` and ``level_columns`` are
# the shares taken for a tree, a tree, and a level; ``watch`` and ``patience`` decide the best round. Bins not named by a set-up are 128.
SETUPS = {
    "a": {"depth": 10, "rate": 0.01, "rounds": 2500, "rows": 0.8, "columns": 0.8, "level_columns": 0.8, "child": 10.0, "gamma": 0.1, "l1": 0.1, "l2": 1.0, "step": 1.0, "bins": 256, "watch": "loss", "patience": 100},
    "b": {"depth": 6, "rate": 0.03, "rounds": 4000, "l2": 15.0, "symmetric": True, "watch": "weighted loss", "patience": 20},
    "c": {"depth": 10, "rate": 0.03, "rounds": 4000, "l2": 4.0, "symmetric": True, "watch": "auc", "patience": 300},
}
PLAIN = {"rows": 1.0, "columns": 1.0, "level_columns": 1.0, "child": 0.0, "gamma": 0.0, "l1": 0.0, "l2": 1.0, "step": 0.0, "bins": 128, "symmetric": False, "watch": "loss", "patience": 100}
#: The log loss of the prediction that every model starts from, a half.
START_LOSS = math.log(2)
TREES = "round int, feature array<int>, cut array<int>, child array<int>, value array<double>, ranks array<array<int>>, held double, loss double, best boolean"


def settings(setup: str | Mapping, **overrides) -> dict:
    return {**PLAIN, **(SETUPS[setup] if isinstance(setup, str) else setup), **overrides}


def quantile_cuts(df: DataFrame, numeric: Sequence[str], bins: int) -> list[list[float]]:
    """For each number, up to ``bins`` - 1 cuts half-way between neighbouring quantiles of all rows; a value's bin is the number of cuts below it."""
    found = df.approxQuantile(list(numeric), [k / bins for k in range(bins + 1)], 0.25 / bins)
    return [[(a + b) / 2 for a, b in zip(values, values[1:])][: bins - 1] for values in (sorted(set(q)) for q in found)]


def binned(
    df: DataFrame, numeric: Sequence[str], indices: Sequence[str], cuts: Sequence[Sequence[float]], keep: Sequence[str], noise: int | None = None, key: str = "id", fold: str = "fold", name: str = "bins"
) -> DataFrame:
    """<keep..., bins>: a byte for each number and each category index of a row. With ``noise``, the seeded noise of that fold is added to the numbers of its training rows before."""
    salt = F.xxhash64(F.col(key), F.lit(SEED + (noise or 0))) if noise is not None else F.lit(0).cast("long")
    own = F.col(fold).cast("int") if noise is not None else F.lit(0)
    rows = df.select(*keep, salt.alias("_salt"), own.alias("_own"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate([*numeric, *indices])])
    edges = [np.array(c) for c in cuts]
    schema = StructType([*[rows.schema[c] for c in keep], StructField(name, BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(len(numeric) + len(indices))]
            out = np.empty((batch.num_rows, len(values)), np.uint8)
            if noise is not None and numeric:
                draws = normal_draws(batch.column("_salt").to_numpy(), len(numeric)) * NOISE_SIGMA * (batch.column("_own").to_numpy() != noise)[:, None]
                values = [v + draws[:, i] if i < len(numeric) else v for i, v in enumerate(values)]
            for i, v in enumerate(values):
                out[:, i] = np.searchsorted(edges[i], v) if i < len(numeric) else np.clip(v, 0, 255)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([r.tobytes() for r in out], pa.binary())], names=schema.names)

    return rows.mapInArrow(work, schema)


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def by_column(bins: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The bins column after column, as wide as indices (so that no sum converts them), and how many bins each column has: what :func:`grow` reads, made once for all trees."""
    table = bins.T.astype(np.int64, order="C")
    return table, (table.max(axis=1, initial=0).astype(int) + 1).tolist()


def _worth(g: np.ndarray, h: np.ndarray, p: Mapping) -> np.ndarray:
    """What nodes of these sums are worth to a cut; ``g`` is overwritten."""
    if p["l1"]:
        np.maximum(np.subtract(np.abs(g, out=g), p["l1"], out=g), 0.0, out=g)
    g *= g
    g /= h + (p["l2"] + 1e-12)
    return g


def _gains(cells: np.ndarray, shape: tuple[int, int], g: np.ndarray, h: np.ndarray, whole: list | None, p: Mapping) -> tuple[np.ndarray, list]:
    """<gain of each cut of a column for each node, sums of the nodes>; ``whole`` are sums that are known already. A node after the last takes the rows of no live node."""
    n, size = shape
    left = [np.cumsum(np.bincount(cells, v, (n + 1) * size)[: n * size].reshape(shape), axis=1) for v in (g, h)]
    whole = whole or [s[:, -1:].copy() for s in left]
    gl, hl = (s[:, :-1] for s in left)
    hr = whole[1] - hl
    gain = _worth(whole[0] - gl, hr, p)
    if p["child"] and not p["symmetric"]:
        bad = (hl < p["child"]) | (hr < p["child"])
    gain += _worth(gl, hl, p)
    gain -= _worth(whole[0].copy(), whole[1], p)
    if p["child"] and not p["symmetric"]:
        gain[bad] = -np.inf
    return gain, whole


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, p: Mapping, rng: np.random.Generator, columnar: tuple[np.ndarray, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree over the rows with h > 0: <feature, cut, child, value, leaf of each row>.

    A node's rows with a bin above its cut go to child + 1, the others to child; child 0 marks a leaf. Nodes of a symmetric tree are numbered like any others.
    Sums are made column by column, each with its own number of bins, so that they stay in the processor's cache.
    """
    n, width = bins.shape
    table, sizes = columnar or by_column(bins)
    l2 = p["l2"]
    own = np.sort(rng.choice(width, max(1, round(width * p["columns"])), replace=False)) if p["columns"] < 1 else np.arange(width)
    feature, cut, child = [0], [0], [0]
    at, live = np.zeros(n, np.int64), np.array([0])
    rows = np.flatnonzero(h > 0)
    some_table, some_g, some_h = (table, g, h) if len(rows) == n else (np.take(table, rows, axis=1), g[rows], h[rows])
    for _ in range(p["depth"]):
        columns = np.sort(rng.choice(own, max(1, round(len(own) * p["level_columns"])), replace=False)) if p["level_columns"] < 1 else own
        slot = np.full(len(feature), -1)
        slot[live] = np.arange(len(live))
        of_node = slot[at[rows]]
        # an empty node has nothing to gain, and one of less curvature than two children need has no cut
        held = of_node >= 0
        counts = np.bincount(of_node[held], minlength=len(live))
        enough = counts > 0
        if p["child"] and not p["symmetric"]:
            enough &= np.bincount(of_node[held], some_h[held], len(live)) >= 2 * p["child"] * (1 - 1e-9)
        live = live[enough]
        if not len(live):
            break
        renamed = np.full(len(enough) + 1, len(live))
        renamed[:-1][enough] = np.arange(len(live))
        of_node = renamed[of_node]
        if counts[enough].sum() < 0.7 * len(rows):
            left = np.flatnonzero(of_node < len(live))
            rows, of_node, some_table, some_g, some_h = rows[left], of_node[left], np.take(some_table, left, axis=1), some_g[left], some_h[left]
        cells = np.empty(len(rows), np.int64)
        whole, best, chosen, bound, starts = None, np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), {}
        for c in columns.tolist():
            size = sizes[c]
            if size < 2:
                continue
            if size not in starts:
                starts[size] = of_node * size
            gain, whole = _gains(np.add(starts[size], some_table[c], out=cells), (len(live), size), some_g, some_h, whole, p)
            if p["symmetric"]:
                gain = gain.sum(axis=0, keepdims=True)
            place = gain.argmax(axis=1)
            top = gain[np.arange(len(gain)), place]
            better = top > best[: len(top)]
            if p["symmetric"]:
                if better[0]:
                    best[:], chosen[:], bound[:] = top[0], c, place[0]
            else:
                best, chosen, bound = np.where(better, top, best), np.where(better, c, chosen), np.where(better, place, bound)
        if p["symmetric"]:
            split = np.arange(len(live) if best[0] > 1e-12 else 0)
        else:
            split = np.flatnonzero(best > max(p["gamma"], 1e-12))
        if not len(split):
            break
        chosen, bound = chosen[split], bound[split]
        nodes, first = live[split], len(feature)
        for k, node in enumerate(nodes.tolist()):
            feature[node], cut[node], child[node] = int(chosen[k]), int(bound[k]), first + 2 * k
        feature += [0] * (2 * len(nodes))
        cut += [0] * (2 * len(nodes))
        child += [0] * (2 * len(nodes))
        to, f_, c_ = np.array(child), np.array(feature), np.array(cut)
        moving = np.flatnonzero(to[at] > 0)
        at[moving] = to[at[moving]] + (bins[moving, f_[at[moving]]] > c_[at[moving]])
        live = np.arange(first, len(feature))
    sums = [np.bincount(at, np.where(h > 0, v, 0.0), len(feature)) for v in (g, h)]
    value = -_soft(sums[0], p["l1"]) / (sums[1] + l2 + 1e-12)
    if p["step"]:
        value = np.clip(value, -p["step"], p["step"])
    return np.array(feature), np.array(cut), np.array(child), value * p["rate"], at


def reached(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(bins), np.int64)
    moving = np.arange(len(bins)) if child[0] else np.zeros(0, np.int64)
    while len(moving):
        node = at[moving]
        at[moving] = child[node] + (bins[moving, feature[node]] > cut[node])
        moving = moving[child[at[moving]] > 0]
    return at


def area(y: np.ndarray, score: np.ndarray) -> float:
    """The area under the ROC curve, ties by half; a half without both classes."""
    values, place = np.unique(score, return_inverse=True)
    n, tp = np.bincount(place, minlength=len(values)), np.bincount(place, y, len(values))
    below = np.cumsum(n - tp) - (n - tp) / 2
    pairs = tp.sum() * (n - tp).sum()
    return float((tp * below).sum() / pairs) if pairs else 0.5


def log_loss(y: np.ndarray, margin: np.ndarray, w: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, margin) - y * margin)).sum() / w.sum()) if w.sum() else 0.0


def ranked(bins: np.ndarray, y: np.ndarray, seen: np.ndarray, first: int) -> list[np.ndarray]:
    """For each category column from ``first`` on, the rank of each index by its smoothed rate on the training rows."""
    prior, out = y[seen].mean() if seen.any() else 0.0, []
    for c in range(first, bins.shape[1]):
        n, s = np.bincount(bins[seen, c], minlength=256), np.bincount(bins[seen, c], y[seen], 256)
        out.append(np.argsort(np.argsort((s + 10 * prior) / (n + 10), kind="stable"), kind="stable").astype(np.int32))
    return out


def boost(bins: np.ndarray, y: np.ndarray, w: np.ndarray, seen: np.ndarray, p: Mapping, seed: int = SEED) -> Iterator[tuple]:
    """<feature, cut, child, value, held, loss> round by round, until ``patience`` rounds in a row were no better on the rows not ``seen``.

    ``held`` is what is watched (small is good), ``loss`` the weighted log loss of the training rows. Without held-out rows all rounds are made.
    """
    rng = np.random.default_rng(seed)
    columnar = by_column(bins)
    margin, best, since = np.zeros(len(y)), math.inf, 0
    watched = {"loss": lambda: log_loss(y[~seen], margin[~seen], np.ones((~seen).sum())), "weighted loss": lambda: log_loss(y[~seen], margin[~seen], w[~seen]), "auc": lambda: -area(y[~seen], margin[~seen])}[p["watch"]]
    for _ in range(p["rounds"]):
        rate = 1 / (1 + np.exp(-margin))
        taken = seen & (rng.random(len(y)) < p["rows"]) if p["rows"] < 1 else seen
        feature, cut, child, value, leaf = grow(bins, np.where(taken, w * (rate - y), 0.0), np.where(taken, np.maximum(w * rate * (1 - rate), 1e-16), 0.0), p, rng, columnar)
        margin += value[leaf]
        held = watched() if not seen.all() else 0.0
        yield feature, cut, child, value, held, log_loss(y[seen], margin[seen], w[seen])
        if not seen.all():
            best, since = (held, 0) if held < best else (best, since + 1)
            if since >= p["patience"]:
                return


def train(rows: DataFrame, setup: str | Mapping, numbers: int, fold: int | None, **overrides) -> DataFrame:
    """The trees of one fold model, a row for each round up to the stop, the best one marked; ``rows`` are <fold, clicked, weight, bins>, ``numbers`` of the bins are numbers.

    All rows meet in one task: bound them first (see ROWS). Without ``fold`` all rows are trained on, for all rounds.
    """
    p = settings(setup, **overrides)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        held = held.sort_by("id")
        y, w = held["clicked"].to_numpy().astype(float), held["weight"].to_numpy().astype(float)
        bins = np.stack([np.frombuffer(b, np.uint8) for b in held["bins"].to_pylist()])
        seen = held["fold"].to_numpy() != fold if fold is not None else np.ones(len(y), bool)
        ranks = ranked(bins, y, seen, numbers)
        for k, r in enumerate(ranks):
            bins[:, numbers + k] = r[bins[:, numbers + k]]
        made = list(boost(bins, y, w, seen, p))
        best = min(range(len(made)), key=lambda k: made[k][4]) if fold is not None else len(made) - 1
        columns = [pa.array(range(len(made)), pa.int32())]
        columns += [pa.array([m[i].tolist() for m in made], pa.list_(pa.int32())) for i in range(3)] + [pa.array([m[3].tolist() for m in made], pa.list_(pa.float64()))]
        columns += [pa.array([[r.tolist() for r in ranks] if k == 0 else None for k in range(len(made))], pa.list_(pa.list_(pa.int32()))), pa.array([m[4] for m in made]), pa.array([m[5] for m in made]), pa.array([k == best for k in range(len(made))])]
        yield pa.RecordBatch.from_arrays(columns, names=["round", "feature", "cut", "child", "value", "ranks", "held", "loss", "best"])

    one = rows.select("id", F.col("clicked").cast("double").alias("clicked"), F.col("weight").cast("double").alias("weight"), F.col("fold").cast("int").alias("fold"), "bins").repartition(1)
    return one.mapInArrow(work, TREES)


def to_best(trees: DataFrame) -> DataFrame:
    """The rounds up to the best one."""
    last = trees.where("best").agg(F.max("round")).first()[0]
    return trees.where(F.col("round") <= F.lit(last))


def loaded(trees: DataFrame) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    """The category ranks and trees of a model, in order; a model has rounds times 2 ** (depth + 1) nodes at most."""
    rows = trees.orderBy("round").collect()
    ranks = [np.array(r, np.uint8) for r in rows[0].ranks]
    return ranks, [(np.array(r.feature), np.array(r.cut), np.array(r.child), np.array(r.value)) for r in rows]


def scored(df: DataFrame, models: Mapping[int, DataFrame], numbers: int, keep: Sequence[str], own: str | None = None) -> DataFrame:
    """<keep..., pred_1, pred_2, ...>: the probability of each row of <keep..., bins> by every fold model, side by side. With ``own``, <keep..., pred>: by the model of the row's fold alone."""
    shared = df.sparkSession.sparkContext.broadcast({k: loaded(m) for k, m in models.items()})
    names = ["pred"] if own else [f"pred_{k}" for k in models]
    schema = StructType([*[df.schema[c] for c in keep], *[StructField(c, DoubleType()) for c in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.stack([np.frombuffer(b, np.uint8) for b in batch.column("bins").to_pylist()]) if batch.num_rows else np.zeros((0, 1), np.uint8)
            of_row = batch.column(own).to_numpy(zero_copy_only=False) if own else None
            single, columns = np.full(batch.num_rows, np.nan), []
            for k, (ranks, trees) in shared.value.items():
                at = np.flatnonzero(of_row == k) if own else np.arange(batch.num_rows)
                bins = raw[at]
                for c, r in enumerate(ranks):
                    bins[:, numbers + c] = r[bins[:, numbers + c]]
                margin = np.zeros(len(at))
                for feature, cut, child, value in trees:
                    margin += value[reached(bins, feature, cut, child)]
                single[at] = rate = 1 / (1 + np.exp(-margin))
                columns.append(rate)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in ([single] if own else columns)]], names=schema.names)

    return df.select(*keep, *([own] if own and own not in keep else []), "bins").mapInArrow(work, schema)


def class_rate_loss(df: DataFrame, label: str = "clicked", weight: str | None = None) -> float:
    """The log loss of the constant prediction that is best for the rows: the weighted rate of the class."""
    w = F.col(weight) if weight else F.lit(1.0)
    total, positive = df.agg(F.sum(w), F.sum(w * F.col(label))).first()
    p = positive / total
    return -sum(x * math.log(x) for x in (p, 1 - p) if x > 0)
