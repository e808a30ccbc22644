"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics
from ...sources.impressions import fold_predictions, table, tied_predictions
from .registry import FOLD_PREDS, TIED, query, r

LOSS = """0.5 * coalesce(avg(-ln(1 - p)) FILTER (WHERE y = 0), 0) + 0.5 * coalesce(avg(-ln(p)) FILTER (WHERE y = 1), 0)"""
BOUNDED = "least(greatest({s}, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"


def ap_sql(rows: str, by: str = "") -> str:
    """Average precision per group of ``rows`` (columns: groups, y, s)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}coalesce(sum(tp * cum_tp / CAST(cum_n AS DOUBLE)) / nullif(sum(tp), 0), 0) AS ap FROM (
  SELECT {keys}tp, sum(tp) OVER w AS cum_tp, sum(n) OVER w AS cum_n FROM (
    SELECT {keys}s, count(*) AS n, sum(y) AS tp FROM {rows} GROUP BY {keys}s) g
  WINDOW w AS ({part}ORDER BY s DESC)) c {group}"""


@query("weighted_logloss", f"""WITH {TIED}
SELECT round({LOSS}, 6) AS wll FROM (SELECT y, {BOUNDED.format(s='s')} AS p FROM tied) x""")
def weighted_logloss(spark, sf):
    return metrics.weighted_logloss(tied_predictions(spark, sf), "y", "s").select(r("wll"))


@query("average_precision", f"""WITH {TIED} SELECT round(ap, 8) AS ap FROM ({ap_sql('tied')}) x""")
def average_precision(spark, sf):
    return metrics.average_precision(tied_predictions(spark, sf), "y", "s").select(r("ap", 8))


@query("competition_score", f"""WITH {TIED},
ap AS ({ap_sql('tied')}),
wll AS (SELECT {LOSS} AS wll FROM (SELECT y, {BOUNDED.format(s='s')} AS p FROM tied) x)
SELECT round(ap, 6) AS ap, round(wll, 6) AS wll, round(0.5 * ap + 0.5 / (1 + wll), 6) AS score FROM ap, wll""")
def competition_score(spark, sf):
    return metrics.competition_score(tied_predictions(spark, sf), "y", "s").select(r("ap"), r("wll"), r("score"))


FOLD_METRICS = f"""{FOLD_PREDS},
both_rows AS (
  SELECT model, fold, clicked AS y, pred AS s FROM preds UNION ALL SELECT model, 0, clicked, pred FROM preds),
ap AS ({ap_sql('both_rows', 'model, fold')}),
wll AS (SELECT model, fold, {LOSS} AS wll FROM (SELECT model, fold, y, {BOUNDED.format(s='s')} AS p FROM both_rows) x GROUP BY model, fold),
fm AS (SELECT model, fold, ap, wll, 0.5 * ap + 0.5 / (1 + wll) AS score FROM ap JOIN wll USING (model, fold))"""


@query("fold_metrics", f"""WITH {FOLD_METRICS}
SELECT model, CAST(fold AS INTEGER) AS fold, round(ap, 6) AS ap, round(wll, 6) AS wll, round(score, 6) AS score FROM fm""")
def fold_metrics(spark, sf):
    scores = metrics.fold_metrics(fold_predictions(spark, sf))
    return scores.select("model", "fold", r("ap"), r("wll"), r("score"))


@query("cv_summary", f"""WITH {FOLD_METRICS}
SELECT model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS folds FROM fm WHERE fold > 0 GROUP BY model""")
def cv_summary(spark, sf):
    summary = metrics.cv_summary(metrics.fold_metrics(fold_predictions(spark, sf)))
    return summary.select("model", r("mean"), r("std"), "folds")


@query("label_metrics", f"""WITH scored AS (
  SELECT d.source, l.quality AS y, least(d.n_chars / 20000.0::DOUBLE, 1) AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
ap AS ({ap_sql('scored', 'source')}),
wll AS (SELECT source, {LOSS} AS wll FROM (SELECT source, y, {BOUNDED.format(s='s')} AS p FROM scored) x GROUP BY source)
SELECT source, round(ap, 6) AS ap, round(wll, 6) AS wll, round(0.5 * ap + 0.5 / (1 + wll), 6) AS score FROM ap JOIN wll USING (source)""")
def label_metrics(spark, sf):
    """Text length as a score for the quality label, per source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    scored = table(spark, sf, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").alias("y"), F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("s")
    )
    return metrics.competition_score(scored, "y", "s", ["source"]).select("source", r("ap"), r("wll"), r("score"))
