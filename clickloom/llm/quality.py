"""Quality rules by distribution divergence: character classes and common words against language references.

Everything is DataFrame functions. A document is compared with the reference of its own language by the
Jensen-Shannon distance (base 2, between 0 and 1) of two histograms: the shares of character classes, and the
shares of the language's commonest words plus the rest. References are sums over all documents of the language
that have at least MIN_WORDS words.

Defined results. Null or empty text: no words, base_failed. Null language: a language of its own. Texts below
MIN_CHARS or LONG_WORDS, and languages whose reference has under MIN_REFERENCE words, are not compared by that histogram (the distance
is null and does not reject). Repeated rows are judged alike, each giving a row. A window of eight words counts as
repeated when its 64-bit hash occurs twice in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, WORD_CHAR, let, stored, words

MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
COMMON_WORDS = 24
MIN_CHARS = 200
LONG_WORDS = 50
MIN_REFERENCE = 2000
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.45
CLASSES = ("space", "lower", "upper", "letter", "digit", "symbol", "punct", "other")
#: Taken out of the text one after the other; what a step takes out is its class.
CLASS_PATTERNS = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "letter": r"\p{L}+",
    "digit": r"\p{Nd}+",
    "symbol": "[#*$%&|<>]+",
    "punct": r"\p{P}+",
}


def with_classes(df: DataFrame) -> DataFrame:
    """Add word_chars and the number of characters of each class, of the column t. The commonest class goes first, so that the other steps read little."""
    (first, pattern), *others = CLASS_PATTERNS.items()
    df = df.withColumn("_size", F.length("t")).withColumn("_rest", F.regexp_replace("t", pattern, "")).withColumn("_left", F.length("_rest"))
    df = df.withColumn(f"c_{first}", F.col("_size") - F.col("_left"))
    for name, pattern in [("space", WORD_BREAK), *others]:
        df = df.withColumn("_rest", F.regexp_replace("_rest", pattern, "")).withColumn("_now", F.length("_rest"))
        df = df.withColumn(f"c_{name}", F.col("_left") - F.col("_now")).withColumn("_left", F.col("_now"))
    return df.withColumn("c_other", F.col("_left")).withColumn("word_chars", F.col("_size") - F.col("c_space")).drop("_rest", "_left", "_now", "_size")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHAR))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def window_hashes(each: Column, width: int) -> Column:
    """A hash for each window of ``width`` (a power of two) hashes: those of windows half as long, two by two."""

    def paired(half: Column, step: int) -> Column:
        n = F.greatest(F.size(half) - F.lit(step), F.lit(0))
        return F.zip_with(F.slice(half, F.lit(1), n), F.slice(half, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    if width == 1:
        return each
    return let(window_hashes(each, width // 2), lambda half: paired(half, width // 2))


def repeated_words(items: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found at least twice.

    Only a text whose window hashes are not all distinct sorts them, with their places, to find the repeated ones;
    the words covered are then summed over the places in order.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(runs: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                before = F.get(runs, i - F.lit(1))["h"]
                after = F.get(runs, i + F.lit(1))["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(runs, again), lambda x: x["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"))
        return F.aggregate(let(placed, places), start, step, lambda a: a["n"])

    n = F.size(items)
    windows = let(F.transform(items, lambda w: F.xxhash64(w)), lambda each: window_hashes(each, width))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n > width, some).otherwise(F.lit(0))


def occurrences(items: Column, common: Column) -> Column:
    """How often each word of ``common`` is among the words, in lower case; one pass leaves the common ones, on which each is counted."""
    lower = F.split(F.lower(F.array_join(items, " ")), " ")
    count = lambda found: F.transform(common, lambda c: (F.size(found) - F.size(F.array_remove(found, c))).cast("long"))
    return let(F.filter(lower, lambda w: F.array_contains(common, w)), count)


def base_counts(docs: DataFrame) -> DataFrame:
    """Add to <t, ...> the counts of the base rules, base_failed and the words."""
    df = with_classes(docs).withColumn("_w", words(F.col("t"))).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("n_repeat_words", repeated_words(F.col("_w")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.select(
        *docs.columns,
        *[f"c_{c}" for c in CLASSES],
        "n_words",
        F.col("word_chars").cast("long"),
        F.col("c_symbol").cast("long").alias("n_symbols"),
        duplicate_lines(F.col("t")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        "_w",
    )


def common_words(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """<lang_key, common>: the commonest words of each language, in lower case, over all documents with at least MIN_WORDS words.

    The ranking is cut per task before it is shuffled, so a language with most of the rows sends only its candidates.
    """
    # a filter on the size would split every text twice
    long_enough = let(words(F.lower("t")), lambda w: F.when(F.size(w) >= MIN_WORDS, w))
    counts = docs.select("lang_key", F.explode(long_enough).alias("word")).groupBy("lang_key", "word").count()
    order = Window.partitionBy("lang_key").orderBy(F.desc("count"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    listed = top.groupBy("lang_key").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("top"))
    return listed.select("lang_key", F.transform("top", lambda x: x["word"]).alias("common"))


def references(counted: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """<lang_key, char_ref, word_ref>: shares of the classes, and of the common words and the rest, over all counted documents."""
    df = counted.where(F.col("n_words") >= MIN_WORDS)
    chars = [F.sum(f"c_{c}").cast("double") for c in CLASSES]
    found = [F.coalesce(F.sum(F.get("found", F.lit(k))), F.lit(0)).cast("double") for k in range(common)]
    total = F.sum("n_words").cast("double")
    add = lambda values: reduce(lambda a, b: a + b, values)
    sums = df.groupBy("lang_key").agg(total.alias("total"), F.array(*chars).alias("chars"), add(chars).alias("size"), F.array(*found, total - add(found)).alias("found"))
    return sums.where(F.col("total") >= MIN_REFERENCE).select(
        "lang_key",
        F.transform("chars", lambda x: x / F.col("size")).alias("char_ref"),
        F.transform("found", lambda x: x / F.col("total")).alias("word_ref"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length."""

    def term(a: Column, b: Column) -> Column:
        half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
        return half(a, b) + half(b, a)

    divergence = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x) / 2
    return F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6)


def _judged(docs: DataFrame, char_limit: float, word_limit: float) -> DataFrame:
    """Rows <row, counts> with both distances and the verdict.

    The texts are read twice: for the words of the languages, and for all counts of each row, which are written. References and
    verdicts need the counts only.
    """
    listed = stored(common_words(docs), "common-words")
    df = base_counts(docs).join(listed, "lang_key", "left")
    counted = stored(df.withColumn("found", occurrences(F.col("_w"), F.col("common"))).drop("t", "_w", "common"), "counted")
    df = counted.join(stored(references(counted), "references"), "lang_key", "left")
    size = F.col("c_space") + F.col("word_chars")
    p_char = F.array(*[F.col(f"c_{c}") / size for c in CLASSES])
    each = [F.coalesce(F.get("found", F.lit(k)), F.lit(0)) for k in range(COMMON_WORDS)]
    rest = F.col("n_words") - reduce(lambda a, b: a + b, each)
    p_word = F.array(*[x / F.col("n_words") for x in [*each, rest]])
    df = df.withColumn("char_distance", F.when(size >= MIN_CHARS, js_distance(p_char, F.col("char_ref"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= LONG_WORDS, js_distance(p_word, F.col("word_ref"))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > char_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def _packed(docs: DataFrame) -> DataFrame:
    lang = F.struct(F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("name"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), lang.alias("lang_key")
    )


def score(docs: DataFrame, char_limit: float = MAX_CHAR_DISTANCE, word_limit: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Counts, distances and verdict of each row of <doc_id, text, lang, ...>."""
    packed = _packed(docs.select("doc_id", "text", "lang")).select("row.doc_id", "t", "lang_key")
    judged = _judged(packed, char_limit, word_limit)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def keep(docs: DataFrame, char_limit: float = MAX_CHAR_DISTANCE, word_limit: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows that pass, with their own columns."""
    return _judged(_packed(docs), char_limit, word_limit).where("kept").select("row.*")
