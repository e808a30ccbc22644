"""Candidate-aware pooling of history vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.sequence import items
from . import histories

MASKED_SCORE = -1e4
MATRIX_BYTES = 256 * 1024 * 1024
ROWS_AT_ONCE = 256
#: Events, about, of the users that one group of :func:`pool_histories` holds; pairs of a row and an item of its history worked on at a time; items up to which a group's products are made for all pairs of items.
GROUP_EVENTS, PAIRS_AT_ONCE, PRODUCT_ITEMS = 50_000, 1 << 16, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def attention_weights(
    df: DataFrame, vectors: DataFrame, key: str = "id", seq: str = "seq", candidate: str = "candidate"
) -> DataFrame:
    """<key, item, times, score, weight>: softmax over each row's own history.

    ``vectors`` is <item, vec>. Repeated items of one history are scored once and
    counted ``times``; items without a vector are masked with a score of -1e4, and a candidate
    without a vector scores 0 against the others. A row without history keeps one row: no item, 0 times, null
    weight. ``key`` tells rows apart. Every group is one history, so its size is that of one sequence.
    """
    item = F.explode_outer(items(F.nullif(F.col(seq), F.lit("")))).alias("item")
    return _weights(df.select(key, F.col(candidate).cast("string").alias("_candidate"), item), vectors, key)


def _weights(bag: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Weights of <key, _candidate, item>; vectors stay behind once they are scored."""
    return bag_weights(bag.groupBy(key, "_candidate", "item").agg(F.count("item").alias("times")), vectors, key)


def bag_weights(counted: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """<key, item, times, score, weight> of counted histories <key, _candidate, item, times>, as :func:`attention_weights` gives them."""
    wanted = vectors.select(F.col("item").alias("_candidate"), F.col("vec").alias("_cvec"))
    met = counted.join(wanted, "_candidate", "left").join(vectors.select("item", "vec"), "item", "left")
    score = F.when(F.col("vec").isNull(), F.lit(MASKED_SCORE)).otherwise(F.coalesce(dot(F.col("_cvec"), F.col("vec")), F.lit(0.0)))
    scored = met.select(key, "item", "times", F.when(F.col("item").isNotNull(), score).alias("score"))
    row = Window.partitionBy(key)
    raised = F.exp(F.col("score") - F.max("score").over(row)) * F.col("times")
    return scored.withColumn("_raised", raised).select(
        key, "item", "times", "score", (F.col("_raised") / F.sum("_raised").over(row)).alias("weight")
    )


def attention_pool_join(
    df: DataFrame, vectors: DataFrame, key: str = "id", seq: str = "seq", candidate: str = "candidate"
) -> DataFrame:
    """<key, pooled> for vector tables of any size; a row whose whole history is masked or missing gives zeros."""
    return pooled(attention_weights(df, vectors, key, seq, candidate), vectors, key)


def pooled(weights: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """<key, pooled>: the weighted means of <key, item, weight>."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    met = weights.join(vectors.select("item", F.col("vec").cast("array<double>").alias("vec")), "item", "left")
    vec = F.coalesce("vec", F.array_repeat(F.lit(0.0), width))
    mean = Summarizer.mean(array_to_vector(vec), F.coalesce("weight", F.lit(1.0)))
    return met.groupBy(key).agg(vector_to_array(mean).alias("pooled"))


def pool_function(matrix: np.ndarray, spark):
    """An Arrow function (codes, candidate code, times) -> pooled vector over whole batches; ``times`` counts each code.

    ``matrix`` holds one row per code; row 0 is padding. A slice of rows is
    worked on at a time, so that memory follows the slice and not the batch.
    """
    shared = spark.sparkContext.broadcast(matrix)

    def pool(codes: pa.Array, candidate: pa.Array, times: pa.Array) -> pa.Array:
        vectors = shared.value
        wanted = candidate.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros((len(codes), vectors.shape[1]))
        for at in range(0, len(codes), ROWS_AT_ONCE):
            part = codes.slice(at, ROWS_AT_ONCE)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            counts = times.slice(at, ROWS_AT_ONCE).flatten().to_numpy(zero_copy_only=False)
            # A missing or empty history is one unknown item.
            blank = (np.cumsum(sizes) - sizes)[sizes == 0]
            flat, counts = np.insert(flat, blank, 0), np.insert(counts, blank, 1)
            sizes = np.maximum(sizes, 1)
            starts = np.cumsum(sizes) - sizes
            history = vectors[flat]
            asked = vectors[wanted[at : at + ROWS_AT_ONCE]]
            score = np.einsum("ij,ij->i", history, np.repeat(asked, sizes, axis=0))
            score[flat == 0] = MASKED_SCORE
            raised = counts * np.exp(score - np.repeat(np.maximum.reduceat(score, starts), sizes))
            weight = raised / np.repeat(np.add.reduceat(raised, starts), sizes)
            out[at : at + ROWS_AT_ONCE] = np.add.reduceat(weight[:, None] * history, starts, axis=0)
        offsets = np.arange(0, out.size + 1, vectors.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return F.arrow_udf(pool, "array<double>")


def vector_matrix(vectors: DataFrame, limit: int = MATRIX_BYTES) -> np.ndarray | None:
    """Row ``idx`` holds the vector of that index (1..n), row 0 is zero. Measured first; None above ``limit`` bytes."""
    last, width = (x or 0 for x in vectors.agg(F.max("idx"), F.max(F.size("vec"))).first())
    if (last + 1) * width * 8 > limit:
        return None
    table = vectors.select("idx", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
    matrix = np.zeros((last + 1, width))
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix[table.column("idx").to_numpy()] = flat.reshape(len(table), width)
    return matrix


def attention_pool(
    df: DataFrame, vectors: DataFrame, key: str = "id", codes: str = "codes", candidate: str = "candidate_code",
    limit: int = MATRIX_BYTES, times: str | None = None,
) -> DataFrame:
    """<key, pooled> from encoded histories and candidates. With ``times`` the codes come once each, with their counts.

    ``vectors`` is <idx, vec> with dense indices from 1, as the vocabulary gives
    them. Up to ``limit`` measured bytes they are sent to the tasks and the rows are not shuffled; beyond
    that they are joined, with equal results.
    """
    matrix = vector_matrix(vectors, limit)
    if matrix is None:
        named = vectors.select(F.col("idx").cast("string").alias("item"), "vec")
        pair = F.explode_outer(F.arrays_zip(F.col(codes).cast("array<string>").alias("item"), F.col(times).alias("times")) if times else F.col(codes).cast("array<string>")).alias("item")
        bag = df.select(key, F.col(candidate).cast("string").alias("_candidate"), pair)
        if times:
            bag = bag.select(key, "_candidate", F.col("item.item").alias("item"), F.coalesce("item.times", F.lit(0)).alias("times"))
            return pooled(bag_weights(bag, named, key), named, key)
        return pooled(_weights(bag, named, key), named, key)
    pool = pool_function(matrix, df.sparkSession)
    counts = F.col(times) if times else F.transform(codes, lambda _: F.lit(1))
    return df.select(key, pool(F.col(codes), F.col(candidate), counts).alias("pooled"))


def _changes(column: pa.Array) -> np.ndarray:
    """True where a sorted column differs from the row before it; nulls are equal."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] = (valid[1:] != valid[:-1]) | other
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, ``count`` numbers."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _pool_group(rows: pa.Table, known: pa.Array, matrix: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """<keys, pooled> of the asked rows of some users, sorted by user and day. Row 0 of ``matrix`` is zero, row i + 1 is the vector of item i of ``known``.

    As in ``histories.bags`` a count holds from the day after a change to the next change of its item, and a change without a day is no state of its own.
    """
    user, day, item = (rows[c].combine_chunks() for c in ("_user", "_day", "_item"))
    new_user = _changes(user)
    new_run = new_user | _changes(day)
    run, runs = np.cumsum(new_run) - 1, np.flatnonzero(new_run)
    of_user = (np.cumsum(new_user) - 1)[runs]
    last = np.flatnonzero(np.append(of_user[1:] != of_user[:-1], True))[of_user]
    dated = (pc.and_(user.is_valid(), day.is_valid())).to_numpy(zero_copy_only=False)[runs]
    code = pc.add(pc.index_in(item, value_set=known), 1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(matrix)
    # changes: a row for each run and code that occurs in it, sorted by user, code and run
    cells, n = np.unique((run * size + code)[item.is_valid().to_numpy(zero_copy_only=False)], return_counts=True)
    at, held = cells // size, cells % size
    order = np.argsort(of_user[at] * size + held, kind="stable")
    at, held, n = at[order], held[order], n[order]
    first = np.append(True, (of_user[at[1:]] != of_user[at[:-1]]) | (held[1:] != held[:-1]))[: len(at)]
    times = np.cumsum(n)
    times -= np.repeat((times - n)[first], np.diff(np.append(np.flatnonzero(first), len(at))))
    until = last[at]
    until[:-1][~first[1:]] = at[1:][~first[1:]]
    low, high = at + 1, until
    some = dated[at] & (high >= low)
    at, held, times, low, high = at[some], held[some], times[some], low[some], high[some]
    edges = np.bincount(low, minlength=len(runs) + 1) - np.bincount(high + 1, minlength=len(runs) + 1)
    sizes = np.where(dated, np.cumsum(edges)[: len(runs)], 0)

    asked = np.flatnonzero(rows["_asked"].combine_chunks().to_numpy(zero_copy_only=False))
    keys, pairs = rows["_key"].combine_chunks(), np.cumsum(sizes[run[asked]])
    product = matrix @ matrix.T if size <= PRODUCT_ITEMS else None
    begin = 0
    while begin < len(asked):
        done = pairs[begin - 1] if begin else 0
        end = min(begin + 16 * ROWS_AT_ONCE, max(begin + 1, int(np.searchsorted(pairs, done + PAIRS_AT_ONCE, "right"))))
        part = asked[begin:end]
        a, b = run[part[0]], run[part[-1]]
        met = (low <= b) & (high >= a)
        start, stop = np.maximum(low[met], a), np.minimum(high[met], b)
        of_run = _spread(start - a, stop - start + 1)
        order = np.argsort(of_run, kind="stable")
        codes, counts = (np.repeat(v[met], stop - start + 1)[order] for v in (held, times))
        bounds = np.cumsum(np.bincount(of_run, minlength=b - a + 1)) - np.bincount(of_run, minlength=b - a + 1)
        width = sizes[run[part]]
        place = _spread(bounds[run[part] - a], width)
        codes, counts, row = codes[place], counts[place], np.repeat(np.arange(len(part)), width)
        wanted = code[part][row]
        score = product[wanted, codes] if product is not None else np.einsum("ij,ij->i", matrix[wanted], matrix[codes])
        score[codes == 0] = MASKED_SCORE
        out = np.zeros((len(part), matrix.shape[1]))
        if len(place):
            full = width > 0
            starts = (np.cumsum(width) - width)[full]
            raised = counts * np.exp(score - np.repeat(np.maximum.reduceat(score, starts), width[full]))
            weight = raised / np.repeat(np.add.reduceat(raised, starts), width[full])
            if product is not None:
                shares = np.zeros((len(part), size))
                shares[row, codes] = weight
                out = shares @ matrix
            else:
                out[full] = np.add.reduceat(weight[:, None] * matrix[codes], starts, axis=0)
        yield keys.take(pa.array(part)), out
        begin = end


def pool_histories(events: DataFrame, vectors: DataFrame, key: str = "id", user: str = "user_id", item: str = "item", group: int = GROUP_EVENTS) -> DataFrame:
    """<key, pooled>: each event's item against the counted items of its user's earlier days, for vector tables of any size.

    ``events`` are <key, user, day, item>, ``vectors`` <item, vec>. Users are dealt to groups of about ``group`` events, and a vector goes once to each group in which its item occurs. So what is
    shuffled is the events and those vectors, not a row for each event and item of its history. A group's vectors meet in one task, and they are no more than its items. Events that share their key
    (or have none) are one row of the result, as :func:`pooled` gives it; they, and vectors whose items are not unique, take its joins. Results are those of :func:`bag_weights` and :func:`pooled`.
    """
    spark = events.sparkSession
    rows = events.select(F.col(key).alias("_key"), F.col(user).alias("_user"), F.col("day").alias("_day"), F.col(item).cast("string").alias("_item"))
    by_key = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    again = (F.col("_n") > 1) | F.col("_key").isNull()
    total, repeated = by_key.agg(F.sum("_n"), F.count_if(again)).first()
    width, most = vectors.groupBy("item").agg(F.max(F.size("vec")).alias("_w"), F.count("item").alias("_n")).agg(F.max("_w"), F.max("_n")).first()
    width = max(width or 0, 0)

    def joined(asked: DataFrame) -> DataFrame:
        bag = histories.bags(rows.select(F.col("_user").alias("user"), F.col("_day").alias("day"), F.col("_item").alias("item")), "user").withColumnRenamed("item", "_held")
        met = asked.select("_key", F.col("_user").alias("user"), F.col("_day").alias("day"), F.col("_item").alias("_candidate")).join(bag, ["user", "day"], "left")
        counted = met.select("_key", "_candidate", F.col("_held").alias("item"), F.coalesce("times", F.lit(0)).alias("times"))
        return pooled(bag_weights(counted, vectors, "_key"), vectors, "_key").withColumnRenamed("_key", key)

    if (most or 0) > 1:
        return joined(rows)
    marked, rest = rows.withColumn("_asked", F.lit(True)), None
    if repeated:
        several = by_key.where(again)
        marked = rows.join(several.select("_key", F.lit(False).alias("_once")), "_key", "left")
        marked = marked.select(*rows.columns, (F.col("_key").isNotNull() & F.coalesce("_once", F.lit(True))).alias("_asked"))
        rest = joined(rows.join(several.select(F.col("_key").alias("_k")), F.col("_key").eqNullSafe(F.col("_k")), "left_semi"))

    groups = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // group), 1)
    group_of = F.pmod(F.xxhash64("_user"), F.lit(groups)).cast("int").alias("_group")
    placed = marked.select(group_of, "*")
    wanted = rows.select(group_of, "_item").where(F.col("_item").isNotNull()).distinct()
    sent = wanted.join(vectors.where(F.col("vec").isNotNull()).select(F.col("item").alias("_item"), F.col("vec").cast("array<double>").alias("_vec")), "_item")
    stream = sent.select("_group", "_item", "_vec").unionByName(placed, allowMissingColumns=True)
    stream = stream.repartition(groups, "_group").sortWithinPartitions("_group", F.col("_vec").isNull(), "_user", "_day")
    schema = StructType([StructField(key, rows.schema["_key"].dataType), StructField("pooled", ArrayType(DoubleType()))])

    def finished(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        vector = whole["_vec"].combine_chunks().is_valid()
        mine = whole.filter(vector)
        matrix = np.zeros((len(mine) + 1, width))
        if len(mine):
            matrix[1:] = mine["_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
        for keys, out in _pool_group(whole.filter(pc.invert(vector)), mine["_item"].combine_chunks(), matrix):
            offsets = np.arange(0, out.size + 1, max(width, 1), dtype=np.int32) if width else np.zeros(len(out) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], None
        for batch in batches:
            numbers = batch.column("_group").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))[: len(numbers)], len(numbers))
            for a, b in zip(cuts, cuts[1:]):
                if held and numbers[a] != number:
                    yield from finished(held)
                    held = []
                held.append(batch.slice(a, b - a))
                number = numbers[a]
        if held:
            yield from finished(held)

    found = stream.mapInArrow(work, schema)
    return found.unionByName(rest) if rest is not None else found
