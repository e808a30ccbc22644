"""The list of registered queries and the shared pieces of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


# Means of two-digit amounts often end in an exact 5. Both sides add this before
# rounding, so that the last bit of a sum does not decide the rounding direction.
NUDGE = 1.37e-7


def r(name: str | Column, digits: int = 6, alias: str | None = None, nudge: float = 0.0) -> Column:
    """A double rounded for comparison between engines."""
    c = F.col(name) if isinstance(name, str) else name
    c = c.cast("double")
    return F.round(c + F.lit(nudge) if nudge else c, digits).alias(alias or name)


EV = """
ev AS (
  SELECT event_id AS id, user_id, ts, CAST(ts AS DATE) AS day,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked,
    lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS "hour",
    CAST(isodow(ts) AS VARCHAR) AS day_of_week,
    CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 2 = 0 THEN '2.0' ELSE '1.0' END AS gender,
    CAST(user_id % 2 AS INTEGER) AS l_feat_1,
    CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 3 % 2 AS INTEGER) END AS l_feat_8,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS l_feat_14,
    event_type, value
  FROM events)"""

USERS = """
us AS (
  SELECT c_custkey AS user_id, CAST(c_nationkey % 8 + 1 AS VARCHAR) AS age_group,
    CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS inventory_id,
    c_nationkey AS l_feat_2, CAST(c_custkey % 11 - 5 AS INTEGER) AS l_feat_3, c_acctbal AS feat_b_1
  FROM customer)"""

ORDERS = """
od AS (
  SELECT o_custkey AS user_id, CAST(count(*) AS DOUBLE) AS history_b_1, avg(o_totalprice) AS history_b_2,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS history_b_3,
    CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE) AS feat_c_1,
    CAST(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS DOUBLE) AS feat_c_2,
    CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE) AS feat_c_3,
    sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS feat_d_1,
    sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS feat_d_2,
    min(o_totalprice) AS feat_e_1, max(o_totalprice) AS feat_e_2
  FROM orders GROUP BY o_custkey)"""

HISTORY = """
daily AS (
  SELECT user_id, day, count(*) AS n, sum(value) AS total,
    count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'error') AS errors,
    count(*) FILTER (WHERE event_type = 'view') AS views,
    sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS view_total,
    sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) AS signup_total,
    sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS error_total
  FROM ev GROUP BY user_id, day),
hi AS (
  SELECT user_id, day,
    CAST(sum(clicks) OVER past AS DOUBLE) / (sum(errors) OVER past + 1) AS history_a_1,
    sum(total) OVER past / sum(n) OVER past AS history_a_2,
    CAST(sum(clicks) OVER past AS DOUBLE) / (sum(views) OVER past + 1) AS history_a_3,
    -sum(total) OVER past AS history_a_4,
    lag(view_total) OVER days AS feat_a_1, lag(signup_total) OVER days AS feat_a_2,
    lag(error_total) OVER days AS feat_a_3, lag(total / n, 2) OVER days AS feat_b_2
  FROM daily
  WINDOW days AS (PARTITION BY user_id ORDER BY day),
    past AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

SEQUENCES = """
earlier AS (
  SELECT d.user_id, d.day, e.ts, e.id, e.l_feat_14
  FROM (SELECT DISTINCT user_id, day FROM ev) d
  JOIN ev e ON e.user_id = d.user_id AND e.day < d.day),
sq AS (
  SELECT user_id, day, string_agg(CAST(l_feat_14 AS VARCHAR), ',' ORDER BY ts, id) AS seq
  FROM earlier GROUP BY user_id, day)"""

WORDS = """
docs AS (
  SELECT doc_id AS id, lang, source, n_chars,
    CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN ''
      ELSE array_to_string([CAST((ascii(w) * 37 + length(w) * 11) % 500 AS VARCHAR) FOR w IN string_split(text, ' ')], ',')
    END AS seq
  FROM documents)"""


def hash_sql(text: str) -> str:
    """The first 32 bits of an MD5 as an integer."""
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


FOLD_PREDS = f"""
preds AS (
  SELECT id, clicked, model, fold,
    w * clicked + (1 - w) * (({hash_sql("CAST(id AS VARCHAR) || model || CAST(fold AS VARCHAR)")} % 1000) / 1000.0::DOUBLE) AS pred
  FROM (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked FROM events) e,
    (VALUES ('a', 0.3::DOUBLE), ('b', 0.2::DOUBLE), ('c', 0.1::DOUBLE)) m(model, w),
    (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS fold) f)"""

TIED = f"""
tied AS (
  SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y,
    0.3::DOUBLE * (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)
    + 0.7::DOUBLE * (({hash_sql("CAST(event_id AS VARCHAR) || 'x'")} % 1000) / 1000.0::DOUBLE) AS s
  FROM events)"""


def model_sql(model: str, w: float) -> str:
    return f"""
sub_{model} AS (
  SELECT event_id AS id, {w}::DOUBLE * (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)
    + (1 - {w}::DOUBLE) * (({hash_sql(f"CAST(event_id AS VARCHAR) || '{model}'")} % 1000) / 1000.0::DOUBLE) AS clicked
  FROM events)"""


MODELS = ",".join(model_sql(m, w) for m, w in (("a", 0.3), ("b", 0.2), ("c", 0.1)))


def imp_sql(*parts: str) -> str:
    """CTEs up to ``imp``, the impression table with the given parts."""
    ctes, cols, joins = [EV], ["ev.*"], []
    for part, cte, name, keys in (
        ("users", USERS, "us", ["user_id"]),
        ("orders", ORDERS, "od", ["user_id"]),
        ("history", HISTORY, "hi", ["user_id", "day"]),
        ("seq", SEQUENCES, "sq", ["user_id", "day"]),
    ):
        if part in parts:
            ctes.append(cte)
            cols.append(f"{name}.* EXCLUDE ({', '.join(keys)})")
            on = " AND ".join(f"ev.{k} = {name}.{k}" for k in keys)
            joins.append(f"LEFT JOIN {name} ON {on}")
    ctes.append(f"\nimp AS (SELECT {', '.join(cols)} FROM ev {' '.join(joins)})")
    return ",".join(ctes)


def with_imp(body: str, *parts: str) -> str:
    return f"WITH {imp_sql(*parts)}\n{body}"


def with_words(body: str) -> str:
    return f"WITH {WORDS}\n{body}"


def avg_of(cols) -> str:
    return f"list_avg([{', '.join(f'CAST({c} AS DOUBLE)' for c in cols)}])"
