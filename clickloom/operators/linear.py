"""Logistic regression and factor machines over crossed inputs that are made anew in every pass.

A row of crosses has hundreds of entries; MLlib keeps those of every model that is fitted, in memory and then on disk. Here the numbers and category hashes of rows are packed once, in compressed blocks; each pass
crosses a block's rows and hands back one partial sum a task. The models of all folds are fitted in the same passes, each on its own rows.

The functions that are minimised are MLlib's: the mean log loss with an L2 penalty of coefficients of standardised inputs (``fit_logistic``), and the mean log loss with AdamW steps over all rows
(``fit_factors``). Models are MLlib's as well, so they are stored, loaded and scored as before.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassificationModel, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crosses

#: Rows of a block, crossed at a time.
SLICE = 2048
#: Rounds, corrections and the tolerance of MLlib's solver.
ROUNDS, CORRECTIONS, TOLERANCE, MEMORY = 100, 10, 1e-6, 20


class Inputs:
    """The numbers, categories and crosses of rows, as :func:`crosses.crossed_vectors` places them."""

    def __init__(self, scale: Mapping[str, tuple[float, float]], categorical: Sequence[str], crossed: Sequence[str], buckets: int = crosses.BUCKETS):
        self.numeric, self.categorical, self.buckets = list(scale), list(categorical), buckets
        self.chosen = [self.numeric.index(c) for c in crossed]
        self.mean, self.deviation = np.array([scale[c][0] for c in scale]), np.array([scale[c][1] for c in scale])
        pairs = list(combinations(self.chosen, 2))
        self.left, self.right = (np.array([p[side] for p in pairs], np.int64) for side in (0, 1))
        self.width, self.pairs = len(self.numeric), len(pairs)
        self.size = self.width + self.pairs + buckets
        self.keys = np.array(self.chosen, np.uint64) + np.uint64(2)

    def place(self, a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
        return (crosses._bucket(a, b, self.buckets) + np.uint64(self.width + self.pairs)).astype(np.int64)

    def single_places(self, codes: np.ndarray) -> np.ndarray:
        """The places of the categories and of the pairs of categories of each row."""
        n = codes.shape[1]
        return np.concatenate([self.place(codes, np.uint64(1)), *[self.place(codes[:, i], codes[:, j])[:, None] for i, j in combinations(range(n), 2)]], axis=1) if n else np.zeros((len(codes), 0), np.int64)


def packed(df: DataFrame, inputs: Inputs, label: str = "clicked", fold: str | None = "fold") -> DataFrame:
    """<size, block>: the labelled rows of ``df`` in blocks of SLICE rows, standardised, categories coded within the block. Store it: every pass reads it again."""
    number = F.coalesce(F.col(fold).cast("int"), F.lit(0)) if fold else F.lit(0)
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), number.alias("_fold"), *crosses.raw_inputs(inputs.numeric, inputs.categorical))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, of = batch.column("_y").to_numpy(), batch.column("_fold").to_numpy().astype(np.int16)
            numbers, codes = crosses.read_inputs(batch, inputs.width, len(inputs.categorical), inputs.mean, inputs.deviation)
            sizes, blocks = [], []
            for a in range(0, len(y), SLICE):
                part = slice(a, a + SLICE)
                coded = [np.unique(codes[part, i], return_inverse=True) for i in range(codes.shape[1])]
                raw = pickle.dumps((y[part], of[part], np.ascontiguousarray(numbers[part].T), [(values, which.astype(np.uint16)) for values, which in coded]))
                sizes.append(len(raw))
                blocks.append(pa.compress(raw, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names=["size", "block"])

    return rows.mapInArrow(work, "size long, block binary")


def summed(blocks: DataFrame, work: Callable[[Iterator[tuple]], tuple]) -> tuple:
    """The sums of ``work`` over all blocks <labels, folds, numbers, categories>: a tuple of numbers and arrays, from one task for each core."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (pickle.loads(pa.decompress(b.as_py(), size.as_py(), "zstd", asbytes=True)) for batch in batches for size, b in zip(batch.column("size"), batch.column("block")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work((y, of, x.T, c) for y, of, x, c in each))], pa.binary())], names=["sums"])

    total = None
    for r in blocks.select("size", "block").coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(partial, "sums binary").collect():
        part = pickle.loads(r.sums)
        total = part if total is None else tuple(a + b for a, b in zip(total, part))
    return total if total is not None else work(iter(()))


def moments(blocks: DataFrame, inputs: Inputs, folds: Sequence[int]) -> tuple:
    """<rows, positives, sums by place, sums of squares by place> of each of the folds, before them those of all other folds together."""

    def work(parts: Iterator[tuple]) -> tuple:
        n, positive, one, two = (np.zeros((len(folds) + 1) * size) for size in (1, 1, inputs.size, inputs.size))
        for y, fold, numbers, categories in parts:
            of = np.zeros(len(y), np.int64)
            for k, number in enumerate(folds):
                of[fold == number] = k + 1
            n += np.bincount(of, minlength=len(n))
            positive += np.bincount(of, y, len(n))
            bounds, places, values, _ = crosses.entries(numbers, codes_of(categories, len(y)), inputs.chosen, inputs.buckets)
            used, at = np.unique(places + np.repeat(of, np.diff(bounds)) * inputs.size, return_inverse=True)
            one[used] += np.bincount(at, values, len(used))
            two[used] += np.bincount(at, values * values, len(used))
        return n, positive, Sparse(one), Sparse(two)

    n, positive, one, two = summed(blocks, work)
    return n, positive, one.values.reshape(len(n), -1), two.values.reshape(len(n), -1)


def codes_of(categories: Sequence[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The category hashes of a block's rows."""
    return np.stack([values[which] for values, which in categories], axis=1) if categories else np.zeros((n, 0), np.uint64)


class Sparse:
    """An array that is handed on as its entries that are not 0."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __add__(self, other: Sparse) -> Sparse:
        return Sparse(self.values + other.values)

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.values)
        return len(self.values), at.astype(np.int32), self.values[at]

    def __setstate__(self, state: tuple) -> None:
        self.values = np.zeros(state[0])
        self.values[state[1]] = state[2]


def log_losses(blocks: DataFrame, inputs: Inputs, models: Mapping[int | None, tuple[np.ndarray, float]]) -> dict:
    """<loss, gradient by place, gradient of the intercept> of each model, summed over the rows it sees: all, or those of the other folds. A model is <coefficients by place, intercept>."""
    names = list(models)
    shared = blocks.sparkSession.sparkContext.broadcast((Sparse(np.stack([models[k][0] for k in names], axis=1).ravel()), np.array([models[k][1] for k in names])))
    count, chosen, width, pairs = len(names), np.array(inputs.chosen, np.int64), inputs.width, inputs.pairs

    def work(parts: Iterator[tuple]) -> tuple:
        loss, grad, flat, tail = np.zeros(count), np.zeros((inputs.size, count)), np.zeros(count), np.zeros((count, inputs.buckets))
        coefficients, intercepts = shared.value[0].values.reshape(-1, count), shared.value[1]
        for y, of, x, categories in parts:
            seen = np.stack([np.ones(len(y), bool) if k is None else (of != k) & (of != 0) for k in names], axis=1)
            single, some = inputs.single_places(codes_of(categories, len(y))), x[:, chosen]
            products = x[:, inputs.left] * x[:, inputs.right]
            margin = x @ coefficients[:width] + products @ coefficients[width : width + pairs] + intercepts
            for i in range(single.shape[1]):
                margin += coefficients[single[:, i]]
            crossed = [(inputs.place(values[:, None], inputs.keys[None, :]), which) for values, which in categories] if len(chosen) else []
            for places, which in crossed:
                if len(places) * 8 < len(y):
                    # few values: all of them for all rows in one product
                    every = some @ coefficients[places].transpose(1, 0, 2).reshape(len(chosen), -1)
                    margin += every.reshape(len(y), len(places), count)[np.arange(len(y)), which]
                else:
                    margin += np.einsum("nj,njf->nf", some, coefficients[places][which])
            loss += np.where(seen, np.logaddexp(0, margin) - y[:, None] * margin, 0.0).sum(axis=0)
            rest = np.where(seen, 1 / (1 + np.exp(-margin)) - y[:, None], 0.0)
            flat += rest.sum(axis=0)
            grad[:width] += x.T @ rest
            grad[width : width + pairs] += products.T @ rest
            at = single.ravel() - (width + pairs)
            for f in range(count if single.shape[1] else 0):
                tail[f] += np.bincount(at, np.repeat(rest[:, f], single.shape[1]), inputs.buckets)
            weighed = (some[:, :, None] * rest[:, None, :]).reshape(len(y), -1) if crossed else None
            for places, which in crossed:
                if len(places) * 8 < len(y):
                    mine = (np.arange(len(places))[:, None] == which[None, :]).astype(float) @ weighed
                else:
                    order = np.argsort(which, kind="stable")
                    mine = np.add.reduceat(weighed[order], np.searchsorted(which[order], np.arange(len(places))), axis=0)
                np.add.at(grad, places.ravel(), mine.reshape(-1, count))
        grad[width + pairs :] += tail.T
        return loss, Sparse(grad.ravel()), flat

    try:
        loss, grad, flat = summed(blocks, work)
    finally:
        shared.destroy()
    return {k: (loss[i], grad.values.reshape(-1, count)[:, i], flat[i]) for i, k in enumerate(names)}


def minimised(x: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, list[float]]]:
    """L-BFGS: yields points, gets <value, gradient>, and returns the best point with the values of all rounds. It stops as MLlib's solver does."""
    value, grad = yield x
    values, past = [value], []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        way, made = grad.copy(), []
        for s, d, rho in reversed(past):
            made.append(rho * s.dot(way))
            way -= made[-1] * d
        way *= past[-1][0].dot(past[-1][1]) / past[-1][1].dot(past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(grad))
        for (s, d, rho), a in zip(past, reversed(made)):
            way += (a - rho * d.dot(way)) * s
        slope, step, found = -grad.dot(way), 1.0, None
        if slope >= 0:
            past.clear()
            continue
        for _ in range(20):
            other = x - step * way
            new, new_grad = yield other
            if math.isfinite(new) and new <= value + 1e-4 * step * slope:
                found = other
                break
            step *= min(max(-slope * step / (2 * (new - value - slope * step)), 0.1), 0.5) if math.isfinite(new) else 0.1
        if found is None:
            break
        s, d = found - x, new_grad - grad
        if s.dot(d) > 1e-12 * d.dot(d):
            past = [*past, (s, d, 1 / s.dot(d))][-CORRECTIONS:]
        x, value, grad = found, new, new_grad
        values.append(value)
        if max(values[-MEMORY:]) - value <= tolerance * abs(values[0]):
            break
    return x, values


def fit_logistic(blocks: DataFrame, inputs: Inputs, folds: Sequence[int | None], penalty: float, rounds: int = ROUNDS) -> dict:
    """<coefficients by place, intercept, values of the objective by round> for each fold k, of the rows of the other folds; for None, of all rows. All are fitted in the same passes."""
    # rows without a fold, numbered 0 here, are seen by the model of all rows alone
    numbers = [0, *[k for k in folds if k is not None]]
    sums = moments(blocks, inputs, numbers)
    solvers, points, models, scales = {}, {}, {}, {}
    for k in folds:
        keep = [i for i, number in enumerate([None, *numbers]) if k is None or number not in (0, k)]
        mine = [v[keep].sum(axis=0) for v in sums]
        mean, square = mine[2] / max(mine[0], 1), mine[3] / max(mine[0], 1)
        spread = square - mean**2
        deviation = np.sqrt(np.where(spread > 1e-10 * square, spread, 0.0) * mine[0] / max(mine[0] - 1, 1))
        used = np.flatnonzero(deviation)
        share = mine[1] / max(mine[0], 1)
        start = np.append(np.zeros(len(used)), math.log(share / (1 - share)) if 0 < share < 1 else 0.0)
        scales[k] = (mine[0], used, mean[used], deviation[used])
        if not 0 < share < 1:
            models[k] = (np.zeros(inputs.size), math.inf if share else -math.inf, [0.0])
            continue
        solvers[k] = minimised(start, rounds)
        points[k] = next(solvers[k])

    def whole(k: int | None, x: np.ndarray) -> tuple[np.ndarray, float]:
        _, used, mean, deviation = scales[k]
        coefficients = np.zeros(inputs.size)
        coefficients[used] = x[:-1] / deviation
        return coefficients, x[-1] - coefficients[used].dot(mean)

    while points:
        found = log_losses(blocks, inputs, {k: whole(k, x) for k, x in points.items()})
        for k, (loss, grad, flat) in found.items():
            n, used, mean, deviation = scales[k]
            x = points[k]
            value = loss / n + penalty / 2 * x[:-1].dot(x[:-1])
            try:
                points[k] = solvers[k].send((value, np.append((grad[used] - mean * flat) / deviation / n + penalty * x[:-1], flat / n)))
            except StopIteration as end:
                models[k] = (*whole(k, end.value[0]), end.value[1])
                del points[k]
    return {k: models[k] for k in folds}


def logistic_model(spark, coefficients: np.ndarray, intercept: float, name: str = "crossed") -> LogisticRegressionModel:
    """MLlib's model of these coefficients."""
    context = spark.sparkContext
    matrix = _py2java(context, DenseMatrix(1, len(coefficients), coefficients))
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"LogisticRegression_{name}", matrix.toSparseRowMajor(), _py2java(context, Vectors.dense([intercept])), 2, False)
    return LogisticRegressionModel(made)


def gaussians(seed: int, n: int) -> np.ndarray:
    """The first ``n`` normal draws of Java's generator, from which MLlib's factors start."""
    state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), []

    def bits(k: int) -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return state >> (48 - k)

    while len(out) < n:
        a, b = (2 * (((bits(26) << 27) + bits(27)) * 2.0**-53) - 1 for _ in range(2))
        square = a * a + b * b
        if 0 < square < 1:
            factor = math.sqrt(-2 * math.log(square) / square)
            out += [a * factor, b * factor]
    return np.array(out[:n])


def factor_losses(blocks: DataFrame, inputs: Inputs, factors: np.ndarray, linear: np.ndarray, intercept: float) -> tuple:
    """<rows, loss, gradients of factors, of coefficients and of the intercept>, summed over all rows. No number takes part in a cross of its own."""
    shared = blocks.sparkSession.sparkContext.broadcast((factors, linear, intercept))
    width, size = inputs.width, inputs.size

    def work(parts: Iterator[tuple]) -> tuple:
        v, w, b = shared.value
        n, loss, flat, one, two = 0, 0.0, 0.0, np.zeros(size), np.zeros(v.shape)
        squares = np.zeros(size)
        for y, _, x, categories in parts:
            place = np.sort(inputs.single_places(codes_of(categories, len(y))), axis=1)
            # entries of one place are one entry
            count = np.zeros(place.shape)
            if place.shape[1]:
                first = np.append(np.ones((len(y), 1), bool), place[:, 1:] != place[:, :-1], axis=1)
                starts = np.flatnonzero(first)
                count.flat[starts] = np.diff(np.append(starts, place.size))
            sums, square = x @ v[:width], (x * x) @ (v[:width] ** 2)
            raw = x @ w[:width] + b
            for i in range(place.shape[1]):
                own = v[place[:, i]] * count[:, i, None]
                sums += own
                square += own * own
                raw += w[place[:, i]] * count[:, i]
            raw += 0.5 * (sums * sums - square).sum(axis=1)
            rest = 1 / (1 + np.exp(-raw)) - y
            n, loss, flat = n + len(y), loss + (np.logaddexp(0, raw) - y * raw).sum(), flat + rest.sum()
            one[:width] += x.T @ rest
            squares[:width] += (x * x).T @ rest
            two[:width] += x.T @ (rest[:, None] * sums)
            if place.shape[1]:
                at, weighed = place.ravel(), (count * rest[:, None])
                one += np.bincount(at, weighed.ravel(), size)
                squares += np.bincount(at, (weighed * count).ravel(), size)
                for f in range(v.shape[1]):
                    two[:, f] += np.bincount(at, (weighed * sums[:, f, None]).ravel(), size)
        return n, loss, Sparse((two - v * squares[:, None]).ravel()), Sparse(one), flat

    try:
        n, loss, two, one, flat = summed(blocks, work)
    finally:
        shared.destroy()
    return n, loss, two.values.reshape(factors.shape), one.values, flat


def fit_factors(blocks: DataFrame, inputs: Inputs, step: float, decay: float, seed: int, size: int = 8, rounds: int = ROUNDS, tolerance: float = TOLERANCE, spread: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """<factors by place, coefficients by place, intercept> after ``rounds`` AdamW steps over all rows, from MLlib's start; ``decay`` is taken of the weights at each step."""
    d = inputs.size
    x = np.concatenate([gaussians(seed, d * size) * spread, np.zeros(d + 1)])
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for k in range(1, rounds + 1):
        n, _, two, one, flat = factor_losses(blocks, inputs, x[: d * size].reshape(d, size), x[d * size : -1], x[-1])
        if not n:
            break
        grad = np.concatenate([two.ravel(), one, [flat]]) / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        before = x
        x = x - (step * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8) + decay * x)
        if np.linalg.norm(before - x) < tolerance * max(np.linalg.norm(x), 1.0):
            break
    return x[: d * size].reshape(d, size), x[d * size : -1], x[-1]


def factor_model(spark, factors: np.ndarray, linear: np.ndarray, intercept: float, name: str = "crossed") -> FMClassificationModel:
    """MLlib's model of these factors."""
    context = spark.sparkContext
    matrix = _py2java(context, DenseMatrix(*factors.shape, factors.ravel(order="F")))
    made = context._jvm.org.apache.spark.ml.classification.FMClassificationModel(f"FMClassifier_{name}", float(intercept), _py2java(context, Vectors.dense(linear)), matrix)
    return FMClassificationModel(made)
