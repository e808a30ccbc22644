"""Personal data by fixed rules, and further identifiers by bootstrapped lexical contexts.

The rules' matches and long hexadecimal keys are seed entities. Every word with a digit or an @ (or seed), of any length, is an instance;
words of digits and separators that follow each other are one. An instance has two patterns: the word before it, or the two words before it, each with the characters that touch it on its left
and its shape, which is a function of its characters alone, for seeds as for others. Spark scores the graph of patterns and instances: a pattern's
confidence is the sum of its distinct instances' scores over the number of those with a score, plus those that speak against it, plus one. A value not found yet says nothing.
Against a pattern speak ordinary values: those that follow ORDINARY or more different single words without any seed there. Numbers that pass the
card check by chance are no evidence: a pattern's cards count only if they are CARDS or more of its numbers of that length.
An instance that is no seed gets the confidence of its best accepted pattern, unless it is ordinary. Rounds go on until no pattern is added; the accepted patterns
mark all their instances. Copies of a value count once, so copied documents prove nothing.

Defined results. Null and empty texts have no spans. Repeated rows each give a row. Added spans never overlap those of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import by_row, stored, text_key

KINDS = ("email", "ip", "card", "phone", "identifier")
#: An address is found from its @: the longest local part before it that the address before has left, and the domain after it.
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: A match can start at the start of a run of digits only, so no run is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LATER = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
CORE = re.compile(r"[0-9A-Za-z](?:.*[0-9A-Za-z])?", re.S)
HEX = re.compile(r"[0-9a-f]+")
NUMBER = re.compile(r"[0-9](?:[-./()]*[0-9])*")
NEXT = re.compile(r"\)?\x20\(?[0-9](?:[-./()]*[0-9])*(?=[^0-9A-Za-z\s]*(?:\s|\Z))")
LETTER = re.compile(r"[^\W\d_]")
DOTTED = re.compile(r"[0-9]+(\.[0-9]+){3,}")
BREAKS = " \t\n\x0b\x0c\r"
#: Context characters looked at on the left, length of a seed key, most digits of a span of several words.
CONTEXT = 80
KEY_LENGTH = 32
MOST_DIGITS = 19
CONFIDENCE = 0.8
SUPPORT = 5
ORDINARY = 3
CARDS = 0.25


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses as <start, end>, in time linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """<start, kind number, end> of the rules' matches, ordered by start, then kind."""
    spans = []
    if "@" in text:
        spans += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def shape_of(value: str) -> str:
    """at, mixed (with letters), dotted (four numbers or more) or digits (with any separators)."""
    if "@" in value:
        return "at"
    if LETTER.search(value):
        return "mixed"
    return "dotted" if DOTTED.fullmatch(value) else "digits"


def _patterns(text: str, start: int, shape: str) -> list[str]:
    left = text[max(0, start - CONTEXT) : start]
    touching = re.search(r"[^\x20\x09-\x0D]*$", left)[0]
    before = left[: len(left) - len(touching)].split()[-2:]
    near = before[-1:] or [""]
    return [f"{' '.join(part)} {touching}<{shape}>".lower() for part in ([near] if len(before) < 2 else [near, before])]


def _digits(value: str) -> int:
    return sum(c.isdigit() for c in value)


def _number(text: str, s: int, e: int, stop: int) -> tuple[int, int]:
    """The span of a number at s:e with its sign or opening bracket and the numbers right after it, before ``stop``."""
    count = _digits(text[s:e])
    while (m := NEXT.match(text, e)) and m.end() <= stop and count + _digits(m[0]) <= MOST_DIGITS:
        e, count = m.end(), count + _digits(m[0])
    if text.find(")", s, e) >= 0 and text[s - 1 : s] == "(" and "(" not in text[s : text.find(")", s, e)]:
        s -= 1
    return s - (text[s - 1 : s] == "+"), e


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """<start, end, value, patterns, seed, base> of seeds and identifier-like words; ``seed`` is 0, FAILED, SEED or CARD_SEED."""
    found = [(s, e, text[s:e].lower(), _patterns(text, s, shape_of(text[s:e])), CARD_SEED if k == 2 else SEED, 1) for s, k, e in base]
    at, covered, reach = -1, 0, 0
    spans = sorted((s, e) for s, _, e in base)
    ends = [reach := max(reach, e) for _, e in spans]
    for m in LATER.finditer(text):
        if m.start() < at:
            continue
        start, at = m.start(), m.end()
        while start and text[start - 1] not in BREAKS:
            start -= 1
        core = CORE.search(text, start, at)
        if not core or not ("@" in core[0] or _digits(core[0])):
            continue
        s, e = core.span()
        while covered < len(spans) and ends[covered] <= s:
            covered += 1
        stop = spans[covered][0] if covered < len(spans) else len(text)
        if stop < e:
            continue
        if NUMBER.fullmatch(core[0]):
            s, e = _number(text, s, e, stop)
            at = max(at, e)
        value = text[s:e].lower()
        shape = shape_of(value)
        seed = int(e - s >= KEY_LENGTH and shape == "mixed" and bool(HEX.fullmatch(value)))
        if shape == "digits" and value[0] != "+" and 12 <= _digits(value) <= 19:
            seed = FAILED
        found.append((s, e, value, _patterns(text, s, shape), seed, 0))
    return found


#: What an instance says: a number of a card's length that is none, nothing, a seed, a seed that is a card.
FAILED, SEED, CARD_SEED = -1, 1, 2
INSTANCE = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("value", StringType()), StructField("patterns", ArrayType(StringType())), StructField("seed", LongType()), StructField("base", LongType())])
SPAN = StructType([StructField("start", LongType()), StructField("kind", LongType()), StructField("end", LongType())])


def extract(docs: DataFrame) -> DataFrame:
    """<doc_id, text_key, spans, found> of each row: the rules' spans and all instances."""
    keyed = docs.select(*text_key(), "text")
    schema = StructType([*keyed.schema.fields[:2], StructField("spans", ArrayType(SPAN)), StructField("found", ArrayType(INSTANCE))])
    span = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
    instance = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.int64()), ("base", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans.append([dict(zip(("start", "kind", "end"), x)) for x in base])
                found.append([dict(zip(("start", "end", "value", "patterns", "seed", "base"), x)) for x in instances(text, base)])
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(instance))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "spans", "found"])

    return keyed.mapInArrow(work, schema)


def accepted_patterns(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, ordinary: int = ORDINARY) -> DataFrame:
    """<pattern, confidence> of the patterns accepted when no more are added, from <patterns, value, seed>."""
    pairs = found.select(F.posexplode("patterns").alias("k", "pattern"), "value", "seed")
    pairs = stored(pairs.groupBy("pattern", "value").agg(F.min("k").alias("k"), F.max("seed").alias("seed")), "pairs")
    count = lambda kind: F.count_if(F.col("seed") == kind)
    facts = pairs.groupBy("pattern").agg(count(SEED).alias("seeds"), count(CARD_SEED).alias("n"), count(FAILED).alias("failed"))
    facts = facts.select("pattern", "seeds", ((F.col("n") > 0) & (F.col("n") >= CARDS * (F.col("n") + F.col("failed")))).alias("cards"))
    seeded = facts.where((F.col("seeds") > 0) | F.col("cards"))
    sides = pairs.join(seeded.select("pattern", "cards", F.lit(True).alias("seeded")), "pattern", "left")
    known = (F.col("seed") == SEED) | (F.col("seed") == CARD_SEED) & F.coalesce("cards", F.lit(False))
    sides = sides.select("pattern", "value", "k", known.alias("known"), F.coalesce("seeded", F.lit(False)).alias("seeded"))
    common = sides.groupBy("value").agg(F.count_if((F.col("k") == 0) & ~F.col("seeded")).alias("n"), F.max("known").alias("sure"))
    common = common.where((F.col("n") >= ordinary) & ~F.col("sure")).select("value", F.lit(True).alias("against"))
    edges = stored(sides.join(common, "value", "left").select("pattern", "value", F.col("known").cast("double").alias("seed"), F.coalesce("against", F.lit(False)).alias("against")), "edges")
    scored, before = edges.withColumn("score", F.col("seed")), -1
    while True:
        totals = scored.groupBy("pattern").agg(
            F.sum("score").alias("sum"), F.count_if((F.col("score") > 0) | F.col("against")).alias("n"), F.count_if(F.col("score") >= confidence).alias("sure")
        )
        totals = totals.select("pattern", (F.col("sum") / (F.col("n") + 1)).alias("confidence"), "sure")
        good = stored(totals.where((F.col("confidence") >= confidence) & (F.col("sure") >= support)), "patterns").drop("sure")
        now = good.count()
        if now <= before or not now:
            return good
        before = now
        best = edges.where(~F.col("against")).join(good, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scored = edges.join(best, "value", "left").select("pattern", "value", "against", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("score"))


def find(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """<doc_id, text_key, base, spans> of each row: arrays of <start, kind, end> ordered by start, then kind."""
    rows = stored(extract(docs), "instances")
    mentions = rows.select("doc_id", "text_key", F.explode("found").alias("x")).select("doc_id", "text_key", "x.*")
    good = accepted_patterns(mentions, confidence, support)
    new = mentions.where("base = 0").select("doc_id", "text_key", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    span = F.struct("start", F.lit(len(KINDS) - 1).cast("long").alias("kind"), "end")
    new = new.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("new"))
    both = by_row(rows, new, "left").withColumnRenamed("spans", "base")
    empty = F.array().cast(ArrayType(SPAN))
    return both.select("doc_id", "text_key", "base", F.sort_array(F.concat("base", F.coalesce("new", empty))).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the rules' spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_identifier")
    return find(docs).select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), added)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by <KIND>; overlapping spans are replaced together, by the kind of the first."""
    found = find(docs).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_key())
    joined = by_row(packed, found, "left").select("row", "spans")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("row.text")

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"].cast("int")))
        later = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"].cast("int")).alias("at"), F.when(later, piece).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    redone = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(redone)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("spans").isNull(), values["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return joined.withColumn("new", new).select(*[v.alias(c) for c, v in values.items()])
