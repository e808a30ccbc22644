"""SQL for the queries that it can express, on the same tables."""

from __future__ import annotations

from . import collocations, licenses, quality, sharding, topk
from .topk import EVERY, TOP

BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _classes() -> str:
    steps, before = [], "bare"
    for name, pattern in quality.CLASS_PATTERNS.items():
        steps.append(f"regexp_replace({before}, '{pattern}', '', 'g') AS x_{name}")
        before = f"x_{name}"
    sizes, left = [], "length(bare)"
    for name in quality.CLASS_PATTERNS:
        sizes.append(f"{left} - length(x_{name}) AS c_{name}")
        left = f"length(x_{name})"
    return ",\n    ".join(steps), ",\n    ".join([*sizes, f"{left} AS c_other"])


def _js(p: str, q: str) -> str:
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    terms = f"[{half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')} FOR z IN list_zip({p}, {q})]"
    return f"round(sqrt(greatest(list_sum({terms}) / 2, 0.0)), 6)"


def quality_sql() -> str:
    steps, sizes = _classes()
    classes = [f"c_{c}" for c in quality.CLASSES]
    k = quality.COMMON_WORDS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('s' || lang, 'n') AS lk FROM documents),
a AS (
  SELECT *, regexp_replace(t, '{BREAK}+', '', 'g') AS bare, regexp_extract_all(t, '{WORD}') AS w, regexp_extract_all(lower(t), '{WORD}') AS lw,
    [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '{WORD}')] AS lines FROM d),
b AS (
  SELECT *, {steps} FROM a),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) > 8)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r),
c AS (
  SELECT b.r, doc_id, lk, lw, len(w) AS n_words, length(bare) AS word_chars, length(t) - length(bare) AS c_space,
    {sizes}, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM b LEFT JOIN rep ON b.r = rep.r),
top AS (
  SELECT lk, word, row_number() OVER (PARTITION BY lk ORDER BY count(*) DESC, word) AS rk
  FROM (SELECT lk, unnest(lw) AS word FROM c WHERE n_words >= {quality.MIN_WORDS}) GROUP BY lk, word
  QUALIFY row_number() OVER (PARTITION BY lk ORDER BY count(*) DESC, word) <= {k}),
cw AS (SELECT lk, list(word ORDER BY rk) AS common FROM top GROUP BY lk),
hits AS (SELECT r, word, count(*) AS n FROM (SELECT r, lk, unnest(lw) AS word FROM c) x JOIN top USING (lk, word) GROUP BY r, word),
grid AS (SELECT c.r, rk, coalesce(n, 0) AS n FROM c JOIN top ON c.lk = top.lk LEFT JOIN hits ON hits.r = c.r AND hits.word = top.word),
found AS (SELECT r, list(n ORDER BY rk) AS f FROM grid GROUP BY r),
e AS (SELECT c.*, list_concat(coalesce(f, []), [0 FOR z IN range({k} - len(coalesce(f, [])))]) AS f FROM c LEFT JOIN found USING (r)),
e2 AS (SELECT *, list_concat(f, [n_words - list_sum(f)]) AS g FROM e),
sums AS (SELECT lk, sum(n_words)::DOUBLE AS total, [{', '.join(f'sum({x})::DOUBLE' for x in classes)}] AS cs, [{', '.join(f'sum(g[{i}])::DOUBLE' for i in range(1, k + 2))}] AS gs
  FROM e2 WHERE n_words >= {quality.MIN_WORDS} GROUP BY lk HAVING sum(n_words) >= {quality.MIN_REFERENCE}),
refs AS (SELECT lk, [x / list_sum(cs) FOR x IN cs] AS char_ref, [x / total FOR x IN gs] AS word_ref FROM sums),
j AS (
  SELECT e2.*, CASE WHEN c_space + word_chars >= {quality.MIN_CHARS} AND char_ref IS NOT NULL THEN {_js("[x / (c_space + word_chars)::DOUBLE FOR x IN [" + ', '.join(classes) + "]]", "char_ref")} END AS char_distance,
    CASE WHEN n_words >= {quality.LONG_WORDS} AND word_ref IS NOT NULL THEN {_js("[x / n_words::DOUBLE FOR x IN g]", "word_ref")} END AS word_distance
  FROM e2 LEFT JOIN refs ON e2.lk = refs.lk)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words)
    AND coalesce(char_distance, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept,
  char_distance, word_distance
FROM j"""


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest
  FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM o"""

TOPK = f"""
WITH v AS (SELECT vec_id, [floor({topk.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}"""

#: The checksum is a fold of table look-ups over the bytes of the text.
SHARDS = f"""
WITH RECURSIVE bits(i, b, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, b + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM bits WHERE b < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE b = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'n') AS stratum, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
bytes AS (SELECT r, list(('0x' || substr(h, 1 + 2 * i, 2))::BIGINT ORDER BY i) AS bs FROM (SELECT r, h, unnest(range(length(h) // 2)) AS i FROM (SELECT r, hex(encode(t)) AS h FROM d)) GROUP BY r),
sums AS (SELECT r, xor(list_reduce(bs, lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc),
f AS (
  SELECT d.*, strlen(t) + 1 AS size, coalesce(text_crc32, 0) AS text_crc32,
    (row_number() OVER (PARTITION BY stratum ORDER BY o, doc_id, text_crc32, strlen(t)) - ('0x' || substr(md5(stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM d LEFT JOIN sums USING (r)),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, o, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS total FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position * {sharding.SHARDS} // total)::INTEGER AS shard,
  (position - ((position * {sharding.SHARDS} // total) * total + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM g"""


def license_sql() -> str:
    """Places and spans from lists of words; suppression by comparing all spans of a document."""
    rows = ",\n  ".join(f"({i}, '{r.label}', {r.rank}, '{r.pattern}', '{r.literal}')" for i, r in enumerate(licenses.rules()))
    places = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split(" ")
        at = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"SELECT r, i, '{label}' AS label FROM (SELECT r, w, unnest(range(len(w) - {len(parts) - 1})) AS i FROM w) WHERE {at}")
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS ({" UNION ALL ".join(places)}),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base_labels FROM base GROUP BY r),
rules(id, label, rank, pattern, literal) AS (VALUES
  {rows}),
norm AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM w WHERE len(w) > 0),
marked AS (
  SELECT r, id, label, rank, string_split_regex(regexp_replace(norm, pattern, chr(1) || '\0' || chr(2), 'g'), ' +') AS m
  FROM norm JOIN rules ON contains(norm, literal) AND regexp_matches(norm, pattern)),
flat AS (SELECT r, id, label, rank, unnest(m) AS word, unnest(range(len(m))) AS i FROM marked),
marks AS (
  SELECT r, id, label, rank, word, i, row_number() OVER (PARTITION BY r, id ORDER BY i) - 1 AS before FROM flat WHERE word IN (chr(1), chr(2))),
spans AS (
  SELECT r, label, rank, min(i - 1 - before) AS "start", max(i - 1 - before) AS "end" FROM marks GROUP BY r, id, label, rank, before // 2),
left_ AS (
  SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = s.r AND b.rank <= s.rank AND b."start" <= s."start" AND b."end" >= s."end" AND (b.rank < s.rank OR b."end" - b."start" > s."end" - s."start"))),
found AS (SELECT r, list(DISTINCT label) AS labels, min(rank) AS best, count(*) AS n FROM left_ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') AS labels,
  coalesce([{', '.join(map(str, licenses.CONFIDENCE))}][best + 1], 0)::DOUBLE AS score, coalesce(n, 0)::BIGINT AS n_detections
FROM w LEFT JOIN based USING (r) LEFT JOIN found USING (r)"""


COLLOCATIONS = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS size) WHERE len(w) >= size) GROUP BY lang, size, phrase),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS x FROM g WHERE size > 1 AND f >= {collocations.LEAST}),
cut AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(x[1:k], ' ')
  JOIN g r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(x[k + 1:], ' ')
  JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.lang = low.lang AND b.size > low.size AND contains(' ' || b.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * b.f >= {collocations.COVERED} * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {collocations.TOP}"""
