"""Chat formatting on token ids: segments encoded apart, reserved ids spliced between, loss masks by prefix sums.

A turn is IM_START, its role and a line break, its text, IM_END and a line break. The control ids
are reserved ones beyond the vocabulary, so no text can produce them; control strings in a text are escaped as well, which keeps the
template readable as plain text: between "<" and "|" one backslash is added, and taken away on reading.

A conversation's ids are its turns' ids one after the other; each turn is a row with the offset of its first id, a running sum of the
lengths before it, so a conversation of any length is never one value. Its loss mask is [loss_start, loss_end).

Defined results. Null roles and texts are empty. Turns with equal numbers are ordered by their ids. A null
conversation or turn id is a value of its own, ordered first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .encoding import byte_pairs, ordinary_ids

START, STOP = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
OPEN = re.compile(r"<(\\*)\|")
CLOSED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line), flags=re.S)


def format_turns(turns: DataFrame, ranks: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """<conv_id, turn, ids, offset, loss_start, loss_end> of each row of <conv_id, turn, role, text>."""
    keys = [turns.schema["conv_id"], turns.schema["turn"]]
    schema = StructType([*keys, StructField("ids", ArrayType(IntegerType(), False)), StructField("before", LongType()), StructField("inside", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(ranks, (START, STOP))
        start, stop = model.encode_single_token(START), model.encode_single_token(STOP)
        line = model.encode_ordinary("\n")
        for batch in batches:
            ids, before, inside = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text")):
                head = [start, *ordinary_ids(model, escape_role(role or "") + "\n")]
                body = ordinary_ids(model, escape(text.as_py() or ""))
                ids.append(np.array([*head, *body, stop, *line], dtype=np.int32))
                before.append(len(head))
                inside.append(len(body) if role == loss_role else 0)
            columns = [batch.column("conv_id"), batch.column("turn"), pa.array(ids, pa.list_(pa.int32())), pa.array(before, pa.int64()), pa.array(inside, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "ids", "before", "inside"])

    made = turns.select("conv_id", "turn", "role", "text").mapInArrow(work, schema)
    earlier = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("ids").cast("long")).over(earlier), F.lit(0))
    made = made.withColumn("offset", offset).withColumn("loss_start", F.col("offset") + F.col("before"))
    return made.select("conv_id", "turn", "ids", "offset", "loss_start", (F.col("loss_start") + F.col("inside")).alias("loss_end"))


def read_back(formatted: DataFrame, ranks: str) -> DataFrame:
    """What the ids of each conversation say, read in order of their offsets; memory is one batch.

    <conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars>
    """
    schema = StructType([formatted.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(ranks, (START, STOP))
        start, stop = model.encode_single_token(START), model.encode_single_token(STOP)
        state = None
        kind = None

        def rows(done: list) -> pa.RecordBatch:
            values = [[c, n, whole.hexdigest(), k, loss.hexdigest(), chars] for c, n, whole, k, loss, chars in done]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values), types)], names=schema.names)

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, ids, offset, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "offset", "loss_start", "loss_end"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(model.decode(ids))
                at = 0
                while start in ids[at:]:
                    first = ids.index(start, at)
                    last = ids.index(stop, first)
                    role, _, text = model.decode(ids[first + 1 : last]).partition("\n")
                    state[1] += 1
                    state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                    at = last + 1
                under = unescape(model.decode(ids[begin - offset : end - offset]))
                state[3] += len(under)
                state[4].update(under.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([state])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "offset")
    return ordered.mapInArrow(work, schema)
