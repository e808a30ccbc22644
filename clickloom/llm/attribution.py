"""Token counts of the sections of whole documents.

A document is encoded once. The spans of its tokens are then joined to the spans of its sections by position (a search of sorted
bounds), and a token that crosses a bound is allocated by the rule: "first" gives it to the section of its first byte, "last" to that of its last
byte, "share" to all by their part of its bytes. Whatever the rule, a document's sections add up to its tokens.

A section is a line with the line break that ends it. Spans are counted in characters outside and in bytes inside, as a token may be
part of a character.

Defined results. Null and empty texts have one empty section without tokens. Rows are not told apart: repeated rows give repeated sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .encoding import byte_pairs, ordinary_ids

RULES = ("first", "last", "share")
LINE = 10
BATCH_ROWS = 100_000


def section_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which lines start."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == LINE) + 1
    starts = np.concatenate(([0], ends))
    return starts[:-1] if len(ends) and ends[-1] == len(data) else starts


def allocate(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section; token_ends and starts are byte offsets of one text of ``size`` bytes."""
    token_starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    if rule == "share":
        bounds = np.union1d(token_ends, np.concatenate((starts[1:], [size])))
        bounds = bounds[bounds > 0]
        begins = np.concatenate(([0], bounds[:-1])) if len(bounds) else bounds
        token = np.searchsorted(token_ends, begins, "right")
        section = np.searchsorted(starts, begins, "right") - 1
        weight = (bounds - begins) / (token_ends - token_starts)[token] if len(bounds) else bounds
        return np.bincount(section, weights=weight, minlength=len(starts))
    at = token_starts if rule == "first" else token_ends - 1
    return np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))


def section_tokens(docs: DataFrame, ranks: str, rule: str = "first") -> DataFrame:
    """<doc_id, section, start, end, n_tokens>: sections of each text with their character spans."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_field = docs.schema["doc_id"]
    count = DoubleType() if rule == "share" else LongType()
    schema = StructType([id_field, *[StructField(c, LongType()) for c in ("section", "start", "end")], StructField("n_tokens", count)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(ranks)
        lengths = np.zeros(model.n_vocab, np.int64)
        for value in model.token_byte_values():
            lengths[model.encode_single_token(value)] = len(value)
        for batch in batches:
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                rows = np.concatenate([np.full(len(c), k) for k, (_, _, _, c) in enumerate(held)])
                ids = pa.array([d for d, *_ in held], batch.schema.field("doc_id").type).take(pa.array(rows))
                sections = np.concatenate([np.arange(len(c)) for _, _, _, c in held])
                columns = [ids, pa.array(sections), *[pa.array(np.concatenate([h[i] for h in held])) for i in (1, 2)], pa.array(np.concatenate([h[3] for h in held]).astype(np.float64 if rule == "share" else np.int64))]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = cell.as_py() or ""
                data = text.encode()
                starts = section_starts(data)
                ends = np.cumsum(lengths[np.array(ordinary_ids(model, text), dtype=np.int64)])
                counts = allocate(ends, starts, len(data), rule)
                if len(data) != len(text):
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                    starts = chars[starts]
                held.append((doc, starts, np.concatenate((starts[1:], [len(text)])), counts))
                size += len(starts)
                if size >= BATCH_ROWS:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, schema)
