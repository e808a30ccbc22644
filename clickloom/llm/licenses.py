"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A to Z) and taken apart into words of digits, letters and characters beyond ASCII; each word stands between two blanks of its own, so that a
signature, a pattern over whole words, never shares a blank with its neighbour. A rule has a label, a rank (0 goes first), a pattern, a keyword and a
literal that every match holds. Texts without any keyword stop there; the patterns of a rule run only where keyword and literal occur. Matches of one rule do not
overlap (leftmost first). A detection is dropped if one of a better rank covers its interval of words, or a longer one of equal rank; equal intervals of equal rank both stay. Labels are those of the base phrases, always, and
those of the detections that stay; the score is the confidence of the best rank left, 0 without any.

The documents are read once. What goes on is a narrow table without texts; only documents with detections are shuffled, by a row number, to be compared within a document: by
running maxima of interval ends for each rank, so no pairs are built.

Defined results. Null and empty texts, and texts without words, have no words, no places (first_word and last_word null), empty labels and score 0. Very long texts are scanned whole. Repeated rows each
give a row. Equal intervals of equal rank give all their labels. An empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The two characters beyond ASCII whose lower case is an ASCII letter.
ODD_CASE = ("K", "İ")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: By rank: a tag, a sentence of the license's own text, a name with its version, a name, a mention.
CONFIDENCE = (1.0, 0.95, 0.9, 0.7, 0.4)
OPEN, CLOSE = "\u0001", "\u0002"

# Signatures: label, rank, pattern. Words are given one by one; [x] may be absent, x/y is either. Longer names come from the same text with other versions by rule below.
SIGNATURES = """
mit 1 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 2 the mit license
mit 2 licensed/released/distributed/available/published under [the] [terms] [of] [the] mit license/licence
mit 3 mit license/licence
mit 3 expat license/licence
mit 4 mit licensed
mit-0 2 mit no attribution [license]
mit-0 2 mit 0 license
x11 1 except as contained in this notice the name of the x consortium shall not be used
x11 3 x11 license/licence
apache-2.0 1 you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 2 apache license/licence [version] 2 [0]
apache-2.0 2 apache [software] license/licence v2 [0]
apache-2.0 2 apache [license] v2 license/licence
apache-2.0 2 asl 2 0
apache-1.1 2 apache [software] license/licence [version] 1 1
apache-1.0 2 apache [software] license/licence [version] 1 0
apache 3 apache [software] license/licence
apache 4 apache licensed
bsd-2-clause 2 bsd 2 clause [license]
bsd-2-clause 2 2 clause bsd [license]
bsd-2-clause 2 two clause bsd [license]
bsd-2-clause 3 simplified bsd [license]
bsd-2-clause 3 freebsd license/licence
bsd-3-clause 1 neither the name of the copyright holder nor the names of its contributors may be used to endorse
bsd-3-clause 2 bsd 3 clause [license]
bsd-3-clause 2 3 clause bsd [license]
bsd-3-clause 2 three clause bsd [license]
bsd-3-clause 3 new bsd [license]
bsd-3-clause 3 modified bsd [license]
bsd-4-clause 1 all advertising materials mentioning features or use of this software must display
bsd-4-clause 2 bsd 4 clause [license]
bsd-4-clause 3 original bsd license/licence
0bsd 2 bsd zero clause [license]
0bsd 2 zero clause bsd [license]
bsd 1 redistribution and use in source and binary forms with or without modification are permitted
bsd 3 bsd style license/licence
bsd 3 bsd license/licence
bsd 4 bsd licensed
isc 1 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 3 isc license/licence
gpl-1.0 2 [gnu] general public license/licence [version] 1 [0]
gpl-2.0 2 [gnu] general public license/licence [as] [published] [by] [the] [free] [software] [foundation] [version/v] 2 [0]
gpl-2.0 2 [gnu] general public license/licence v2 [0]
gpl-2.0 2 gnu gpl [version/v] 2 [0]
gpl-2.0 2 gplv2
gpl-2.0 2 gpl 2 0
gpl-2.0 2 gpl version/v 2
gpl-3.0 2 [gnu] general public license/licence [as] [published] [by] [the] [free] [software] [foundation] [version/v] 3 [0]
gpl-3.0 2 [gnu] general public license/licence v3 [0]
gpl-3.0 2 gnu gpl [version/v] 3 [0]
gpl-3.0 2 gplv3
gpl-3.0 2 gpl 3 0
gpl-3.0 2 gpl version/v 3
gpl 1 you can redistribute it and or modify it under the terms of the gnu general public license
gpl 3 [gnu] general public license/licence
gpl 3 gnu gpl
gpl 4 under the gpl
gpl 4 gpl licensed
lgpl-2.0 2 [gnu] library general public license/licence [version/v] 2 [0]
lgpl-2.1 2 [gnu] lesser general public license/licence [version/v] 2 1
lgpl-2.1 2 [gnu] lesser general public license/licence v2 1
lgpl-2.1 2 lgplv2 1
lgpl-2.1 2 lgpl 2 1
lgpl-3.0 2 [gnu] lesser general public license/licence [version/v] 3 [0]
lgpl-3.0 2 lgplv3
lgpl-3.0 2 lgpl 3 0
lgpl 2 [gnu] lesser/library general public license/licence
lgpl 3 gnu lgpl
lgpl 4 under the lgpl
agpl-3.0 2 [gnu] affero general public license/licence [version/v] 3 [0]
agpl-3.0 2 [gnu] affero general public license/licence v3 [0]
agpl-3.0 2 agplv3
agpl-3.0 2 agpl 3 0
agpl 2 [gnu] affero general public license/licence
agpl 3 gnu agpl
gfdl-1.2 2 [gnu] free documentation license/licence [version] 1 2
gfdl-1.3 2 [gnu] free documentation license/licence [version] 1 3
gfdl 3 [gnu] free documentation license/licence
mpl-1.0 2 mozilla public license/licence [version/v] 1 0
mpl-1.1 2 mozilla public license/licence [version/v] 1 1
mpl-2.0 1 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 2 mozilla public license/licence [version/v] 2 [0]
mpl-2.0 2 mplv2 [0]
mpl-2.0 2 mpl 2 0
mpl 3 mozilla public license/licence
epl-1.0 2 eclipse public license/licence [version/v] 1 0
epl-2.0 2 eclipse public license/licence [version/v] 2 0
epl 3 eclipse public license/licence
edl-1.0 2 eclipse distribution license/licence [version/v] 1 0
cpl-1.0 2 common public license/licence [version/v] 1 0
cpl-1.0 3 common public license/licence
ipl-1.0 3 ibm public license/licence
cddl-1.0 2 common development and distribution license/licence [version] 1 0
cddl-1.1 2 common development and distribution license/licence [version] 1 1
cddl 3 common development and distribution license/licence
cddl 4 under the cddl
unlicense 1 this is free and unencumbered software released into the public domain
unlicense 3 the unlicense
cc0-1.0 2 cc0 1 0 [universal]
cc0-1.0 2 creative commons zero [v1] [0] [universal]
cc0-1.0 3 cc0 [public] [domain] [dedication]
public-domain 3 dedicated to the public domain
public-domain 3 released into the public domain
public-domain 3 in the public domain
public-domain 4 public domain
wtfpl 2 do what the fuck you want to public license
wtfpl 3 wtfpl
zlib 1 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 3 zlib license/licence
zlib 3 zlib libpng license/licence
libpng 3 libpng license/licence
bsl-1.0 2 boost software license/licence [version] 1 0
bsl-1.0 3 boost software license/licence
artistic-1.0 2 artistic license/licence 1 0
artistic-2.0 2 artistic license/licence [version] 2 0
artistic 3 artistic license/licence
perl 3 same terms as perl itself
python-2.0 2 python software foundation license/licence [version] 2
python-2.0 3 python software foundation license/licence
python-2.0 3 psf license/licence
ruby 3 ruby license/licence
ruby 3 same terms as ruby
php-3.01 2 php license/licence [version] 3 01
php 3 php license/licence
postgresql 3 postgresql license/licence
openssl 3 openssl license/licence
ncsa 2 university of illinois ncsa open source license/licence
ncsa 3 ncsa open source license/licence
curl 3 curl license/licence
icu 3 icu license/licence
unicode 3 unicode license/licence agreement
w3c 2 w3c software notice and license/licence
w3c 3 w3c software license/licence
ofl-1.1 2 sil open font license/licence [version] 1 1
ofl 3 [sil] open font license/licence
eupl-1.1 2 european union public licence/license [version/v] 1 1
eupl-1.2 2 european union public licence/license [version/v] 1 2
eupl 3 european union public licence/license
osl-3.0 2 open software license/licence [version/v] 3 0
osl 3 open software license/licence
afl-3.0 2 academic free license/licence [version/v] 3 0
afl 3 academic free license/licence
ecl-2.0 2 educational community license/licence [version] 2 0
ms-pl 3 microsoft public license/licence
ms-rl 3 microsoft reciprocal license/licence
ms-eula 3 microsoft software license terms
cecill-2.1 2 cecill free software license/licence agreement [version] 2 1
cecill 3 cecill license/licence
mulan-psl-2.0 2 mulan permissive software license/licence [version/v] 2
mulan-psl-2.0 2 mulan psl v2
odbl-1.0 2 open database license/licence [version/v] 1 0
odbl 3 open database license/licence
odc-by-1.0 2 open data commons attribution license/licence
pddl-1.0 2 public domain dedication and license/licence
ogl-uk-3.0 2 open government licence/license [version/v] 3 [0]
ogl-uk 3 open government licence/license
upl-1.0 3 universal permissive license/licence
qpl-1.0 3 q public license/licence
sleepycat 3 sleepycat license/licence
tcl 3 tcl tk license/licence
vim 3 vim license/licence
json 1 the software shall be used for good not evil
beerware 3 beer ware license/licence
nasa-1.3 3 nasa open source agreement
intel 3 intel open source license/licence
sspl-1.0 2 server side public license/licence
busl-1.1 2 business source license/licence
elastic-2.0 2 elastic license/licence 2 0
elastic 3 elastic license/licence
polyform 3 polyform noncommercial/shield/strict [license]
commons-clause 3 commons clause
openrail 3 openrail license/licence
openrail 3 open rail m
llama 3 llama community license/licence
freeware 4 this is freeware
proprietary 1 unauthorized copying of this file via any medium is strictly prohibited
proprietary 3 proprietary and confidential
proprietary 3 all rights are reserved
proprietary 4 for internal use only
reserved 3 all rights reserved
copyright 4 copyright c [0-9]{4}
copyright 4 copyright [0-9]{4}
copyright 4 copyright ©
"""

#: Creative Commons licenses by rule: name parts in tags, and in words.
CC_KINDS = {
    "by": "attribution", "by sa": "attribution share/sharealike [alike]", "by nc": "attribution non/noncommercial [commercial]", "by nd": "attribution no/noderivatives/noderivs [derivatives/derivs]",
    "by nc sa": "attribution non/noncommercial [commercial] share/sharealike [alike]", "by nc nd": "attribution non/noncommercial [commercial] no/noderivatives/noderivs [derivatives/derivs]",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


#: Words that open no rule.
ORDINARY = frozenset("under the new open common terms this of in for only is by or any to as".split())


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    pattern: str
    keyword: str
    literal: str


def compiled(label: str, rank: int, signature: str) -> Rule:
    """A signature as a regular expression over blank-framed words, with its literal (the longest run of plain words) and keyword (the longest plain word)."""
    parts, runs = [], [[]]
    for token in signature.split(" "):
        inner = token.strip("[]") if token.startswith("[") and token.endswith("]") else token
        choice = inner.split("/")
        body = f" {inner} " if len(choice) == 1 else f" (?:{'|'.join(choice)}) "
        if inner is not token:
            parts.append(f"(?:{body})?")
            runs.append([])
        else:
            parts.append(body)
            if len(choice) == 1 and re.fullmatch(r"[0-9a-z\u0080-￿]+", inner):
                runs[-1].append(inner)
            else:
                runs.append([])
    best = max(runs, key=lambda r: sum(len(w) for w in r if w not in ORDINARY))
    keyword = max(best, key=lambda w: (w not in ORDINARY, len(w)), default="")
    if not keyword or keyword in ORDINARY:
        raise ValueError(f"a signature needs a plain word that is not ordinary: {signature}")
    return Rule(label, rank, "".join(parts), f" {keyword} ", "".join(f" {w} " for w in best))


@lru_cache
def rules() -> tuple[Rule, ...]:
    """The written signatures, those of the Creative Commons family, and a tag for each label with a version or a plain name."""
    made = []
    for line in SIGNATURES.strip().splitlines():
        label, rank, signature = line.split(" ", 2)
        made.append(compiled(label, int(rank), signature))
    for kind, words in CC_KINDS.items():
        label = "cc-" + kind.replace(" ", "-")
        made.append(compiled(label, 3, f"cc {kind}"))
        made.append(compiled(label, 3, f"creative commons {words}"))
        for version in CC_VERSIONS:
            exact = f"{label}-{version.replace(' ', '.')}"
            made.append(compiled(exact, 2, f"cc {kind} [version/v] {version}"))
            made.append(compiled(exact, 2, f"creative commons {words} {version}"))
    for label in sorted({r.label for r in made} - {"reserved", "copyright", "proprietary", "public-domain", "freeware"}):
        name = re.sub("[-.]", " ", label)
        made.append(compiled(label, 0, f"spdx license identifier {name} [only/or] [later]"))
    return tuple(dict.fromkeys(made))


def lowered(text: Column) -> Column:
    """A to Z in lower case, other letters of no matter: their lower case is never ASCII but for ODD_CASE."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ODD_CASE])
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def framed(text: Column) -> Column:
    """The words of a lower-cased text, each between two blanks of its own; empty without words."""
    bare = F.btrim(F.regexp_replace(text, SEPARATORS, "  "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def n_words(framed_text: Column) -> Column:
    return ((F.length(framed_text) - F.length(F.replace(framed_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(phrase: str) -> tuple[Column, Column, Column]:
    """<places, first start, last start> of a phrase in the column ``norm``."""
    literal, size = "".join(f" {w} " for w in phrase.split(" ")), len(phrase.split(" "))
    here = F.contains("norm", F.lit(literal))
    count = ((F.length("norm") - F.length(F.replace("norm", F.lit(literal), F.lit("")))) / len(literal)).cast("long")
    first = n_words(F.substring_index("norm", literal, 1))
    last = F.col("n_words") - n_words(F.substring_index("norm", literal, -1)) - size
    return F.when(here, count).otherwise(F.lit(0).cast("long")), F.when(here, first), F.when(here, last)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_array() -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('label', {_quoted(r.label)}, 'rank', {r.rank}, 'pattern', {_quoted(r.pattern)}, 'keyword', {_quoted(r.keyword)}, 'literal', {_quoted(r.literal)})" for r in rules()) + ")")


def _spans(norm: Column, rule: Column) -> Column:
    """All matches of a rule as <label, rank, start, end> in words, from a copy in which they stand between marks."""
    marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), " +")
    at = lambda mark: F.filter(F.transform(marked, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
    # the j-th opening mark has 2 j marks before it, the j-th closing one 2 j + 1, and both the empty part before the first blank
    return F.zip_with(
        F.transform(at(OPEN), lambda p, j: p - F.lit(1) - F.lit(2) * j), F.transform(at(CLOSE), lambda p, j: p - F.lit(2) - F.lit(2) * j),
        lambda s, e: F.struct(rule["label"].alias("label"), rule["rank"].alias("rank"), s.alias("start"), e.alias("end")),
    )


def detect(docs: DataFrame) -> DataFrame:
    """<doc_id, n_words, n_base, first_word, last_word, base_labels, spans> of each row of <doc_id, text>; ``spans`` before any suppression, null without a keyword."""
    rows = docs.select("doc_id", framed(lowered(F.coalesce("text", F.lit("")))).alias("norm")).withColumn("n_words", n_words(F.col("norm")))
    counts, firsts, lasts = zip(*[_base(p) for p in BASE])
    named = F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, BASE.values())])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules()})])
    rows = rows.withColumns({
        "n_base": reduce(lambda a, b: a + b, counts),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base_labels": F.sort_array(F.array_compact(named)),
        "held": F.filter(keywords, lambda k: F.contains("norm", k)),
    })
    chosen = F.filter(_rule_array(), lambda r: F.array_contains("held", r["keyword"]) & F.contains("norm", r["literal"]))
    spans = F.flatten(F.transform(chosen, lambda r: _spans(F.col("norm"), r)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.when(F.size("held") > 0, spans).alias("spans"))


def suppressed(spans: DataFrame, key: str) -> DataFrame:
    """<key, ..., label, rank, start, end> without the spans that another one covers.

    By start, the largest end so far of the spans of each rank and better tells all: a better rank that starts no later and reaches the end covers a span, and so does an equal rank that starts
    earlier and reaches it, or starts no later and goes beyond it.
    """
    by_start = Window.partitionBy(key).orderBy("start")
    to_here, earlier = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow), by_start.rangeBetween(Window.unboundedPreceding, -1)
    ranks = range(len(CONFIDENCE))
    ends = {f"_{name}_{k}": F.max(F.when(F.col("rank") <= k, F.col("end"))).over(w) for k in ranks for name, w in (("here", to_here), ("before", earlier))}
    of_rank = lambda name, less: F.coalesce(*[F.when(F.col("rank") == k, F.col(f"_{name}_{k - less}")) for k in ranks[less:]], F.lit(-1))
    covered = (of_rank("here", 1) >= F.col("end")) | (of_rank("before", 0) >= F.col("end")) | (of_rank("here", 0) > F.col("end"))
    return spans.withColumns(ends).where(~covered).drop(*ends)


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places, labels, score and the number of detections that stay, of each row of <doc_id, text>."""
    rows = stored(detect(docs).withColumn("row", F.monotonically_increasing_id()), "license-spans")
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    some = F.coalesce(F.size("spans"), F.lit(0)) > 0
    none = rows.where(~some).select(*own, F.col("base_labels").alias("all"), F.lit(None).cast("int").alias("best"), F.lit(0).cast("long").alias("n_detections"))
    spans = rows.where(some).select("row", *own, F.inline("spans"))
    left = suppressed(spans, "row").groupBy("row").agg(
        *[F.first(c).alias(c) for c in own], F.collect_set("label").alias("found"), F.min("rank").alias("best"), F.count(F.lit(1)).alias("n_detections")
    )
    left = left.select(*own, F.sort_array(F.array_union("base_labels", "found")).alias("all"), "best", "n_detections")
    confidence = F.coalesce(F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("best")), F.lit(0.0))
    return none.unionByName(left).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"), confidence.alias("score"), "n_detections"
    )
