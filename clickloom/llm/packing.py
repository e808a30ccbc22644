"""Sum-of-squares packing of token documents into windows of fixed length.

Every input partition packs its own documents as they come: a document's full windows are cut off, and its last piece goes
to the fill level h for which the sum of squares of N(h), the number of open windows at each level, grows least (ties: the
fullest window). Levels and their windows are kept in a level array. The last pieces, HOLD windows' worth, are held back and cut at the
end of the partition to fill what is still open, so that a partition pads one window in all, unless more than those are open.
A partition is one packer whatever its size: memory is the open windows and the pieces held back.

Defined results. Null and empty texts are the end id alone. Rows are not told apart, so repeated rows are packed each. An empty table
gives no rows. An executor lost with a partition has the whole partition packed again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .encoding import chunk_encoder

WINDOW = 4096
END = 2
HOLD = 64
BATCH_BYTES = 8 << 20


class SumOfSquares:
    """Where pieces go; open windows by fill level."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The window and the offset of a piece of ``size`` tokens."""
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        fresh = 0 if size == self.window else 2 * int(self.count[size]) + 1
        if len(levels):
            closes = levels + size == self.window
            growth = np.where(closes, 1 - 2 * self.count[levels], 2 * (self.count[np.where(closes, 0, levels + size)] - self.count[levels]) + 2)
            low = int(growth.min())
            if low <= fresh:
                level = int(levels[np.flatnonzero(growth == low)[-1]])
                return self._fill(self.open[level].pop(), level, size)
        self.next += 1
        return self._fill(self.next - 1, 0, size)

    def _fill(self, window: int, level: int, size: int) -> tuple[int, int]:
        if level:
            self.count[level] -= 1
        if level + size < self.window:
            self.count[level + size] += 1
            self.open[level + size].append(window)
        return window, level

    def place_in_fullest(self, most: int) -> tuple[int, int, int]:
        """Window, offset and length of a piece cut to at most ``most`` tokens."""
        levels = np.flatnonzero(self.count)
        if not len(levels):
            size = min(most, self.window)
            return *self.place(size), size
        level = int(levels[-1])
        size = min(most, self.window - level)
        return *self._fill(self.open[level].pop(), level, size), size


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, hold: int = HOLD) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (unsigned 32-bit, little endian), doc_tokens, sequence_id, offset."""
    id_type = docs.schema["doc_id"].dataType
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = StructType([StructField("doc_id", id_type), *[StructField(c, LongType()) for c in longs], StructField("ids", BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        held: deque[tuple] = deque()
        held_size, rows, size = 0, [], 0
        types = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            fields = [("doc_id", types), *[(c, pa.int64()) for c in longs], ("ids", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        def add(doc, start: int, length: int, ids: bytes, at: tuple[int, int]) -> None:
            nonlocal size
            rows.append((doc, start, length, len(ids) >> 2, *at, ids[4 * start : 4 * (start + length)]))
            size += 4 * length + 64

        for batch in batches:
            types = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids += end.to_bytes(4, "little")
                total = len(ids) >> 2
                start = total - total % window
                for at in range(0, start, window):
                    add(doc, at, window, ids, packer.place(window))
                if start < total:
                    held.append((doc, start, ids))
                    held_size += total - start
                while held and held_size > hold * window:
                    doc_, start_, ids_ = held.popleft()
                    length = (len(ids_) >> 2) - start_
                    held_size -= length
                    add(doc_, start_, length, ids_, packer.place(length))
                if size > BATCH_BYTES:
                    yield flush()
                    rows, size = [], 0
        for doc, start, ids in held:
            while start < len(ids) >> 2:
                *at, length = packer.place_in_fullest((len(ids) >> 2) - start)
                add(doc, start, length, ids, tuple(at))
                start += length
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, schema)
