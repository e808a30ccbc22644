"""Row-wise statistics queries over column groups."""

from __future__ import annotations

from ...functions import horizontal as H
from ...functions.values import flag
from ...sources.impressions import impressions, table
from .. import features
from ..config import DEFAULT
from .registry import NUDGE, query, r, with_imp

ALL = ("users", "orders", "history")
HIST_A = ("history_a_1", "history_a_2", "history_a_3", "history_a_4")
HIST_B = ("history_b_1", "history_b_2", "history_b_3")
L_FEAT = ("l_feat_1", "l_feat_2", "l_feat_3", "l_feat_8", "l_feat_14")
GROUPS = {
    "feat_a": ("feat_a_1", "feat_a_2", "feat_a_3"),
    "feat_b": ("feat_b_1", "feat_b_2"),
    "feat_c": ("feat_c_1", "feat_c_2", "feat_c_3"),
    "feat_d": ("feat_d_1", "feat_d_2"),
    "feat_e": ("feat_e_1", "feat_e_2"),
}
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL_STATS = {"mean": "avg", "max": "max", "min": "min", "sum": "sum", "std": "stddev_samp"}


def stat_sql(stat: str, cols, dtype: str = "DOUBLE") -> str:
    """One statistic over the columns of a row, nulls skipped; the sum of nothing is 0."""
    listed = "[" + ", ".join(f"CAST(CAST({c} AS {dtype}) AS DOUBLE)" for c in cols) + "]"
    value = f"list_aggregate({listed}, '{SQL_STATS.get(stat, stat)}')"
    return f"coalesce({value}, 0)" if stat == "sum" else value


def stats_sql(groups, stats, digits: int = 4) -> str:
    return ", ".join(
        f"round({stat_sql(s, cols)} + {NUDGE}, {digits}) + 0.0 AS {name}_{s}" for name, cols in groups.items() for s in stats
    )


def made(groups, stats, digits: int = 4):
    return [r(f"{name}_{s}", digits, nudge=NUDGE) for name in groups for s in stats]


@query("group_mean_max_min", with_imp(
    f"SELECT id, {stats_sql({**GROUPS, 'history_a': HIST_A}, ('mean', 'max', 'min'))} FROM imp", *ALL))
def group_mean_max_min(spark, sf):
    groups, stats = {**GROUPS, "history_a": HIST_A}, ("mean", "max", "min")
    df = features.group_stats(impressions(spark, sf, *ALL), {g: (c, stats) for g, c in groups.items()})
    return df.select("id", *made(groups, stats))


@query("group_std", with_imp(f"SELECT id, {stats_sql({**GROUPS, 'history_a': HIST_A}, ('std',))} FROM imp", *ALL))
def group_std(spark, sf):
    groups = {**GROUPS, "history_a": HIST_A}
    df = features.group_stats(impressions(spark, sf, *ALL), {g: (c, ("std",)) for g, c in groups.items()})
    return df.select("id", *made(groups, ("std",)))


@query("feat_a_sparsity", with_imp("""
SELECT id, n AS feat_a_nonzero_count, CAST(n = 0 AS TINYINT) AS feat_a_is_sparse FROM (
  SELECT id, CAST(coalesce(CAST(feat_a_1 <> 0 AS INTEGER), 0) + coalesce(CAST(feat_a_2 <> 0 AS INTEGER), 0)
    + coalesce(CAST(feat_a_3 <> 0 AS INTEGER), 0) AS INTEGER) AS n FROM imp) x""", "history"))
def feat_a_sparsity(spark, sf):
    n = H.nonzero_count(GROUPS["feat_a"])
    return impressions(spark, sf, "history").select(
        "id", n.alias("feat_a_nonzero_count"), flag(n == 0).alias("feat_a_is_sparse")
    )


@query("l_feat_stats", with_imp(f"SELECT id, {stats_sql({'l_feat': L_FEAT}, ('sum', 'mean', 'min', 'max'))} FROM imp", "users"))
def l_feat_stats(spark, sf):
    stats = ("sum", "mean", "min", "max")
    df = features.group_stats(impressions(spark, sf, "users"), {"l_feat": (L_FEAT, stats)})
    return df.select("id", *made({"l_feat": L_FEAT}, stats))


MEAN, SPREAD = stat_sql("mean", L_FEAT), f"coalesce({stat_sql('stddev_pop', L_FEAT)}, 0)"


@query("l_feat_std_population", with_imp(f"SELECT id, round({SPREAD}, 4) AS l_feat_std FROM imp", "users"))
def l_feat_std_population(spark, sf):
    df = impressions(spark, sf, "users").withColumn("_mean", H.row_mean(L_FEAT))
    return df.select("id", r(H.row_std_population(L_FEAT, "_mean"), 4, "l_feat_std"))


@query("l_feat_z", with_imp(f"""
SELECT id, round(({stat_sql('max', L_FEAT)} - {MEAN}) / ({SPREAD} + 1e-6), 4) AS l_feat_zmax,
  round(({stat_sql('min', L_FEAT)} - {MEAN}) / ({SPREAD} + 1e-6), 4) AS l_feat_zmin FROM imp""", "users"))
def l_feat_z(spark, sf):
    df = features.first_stage(impressions(spark, sf, "users"), frequency=())
    return df.select("id", r("l_feat_zmax", 4), r("l_feat_zmin", 4))


@query("hist_means", with_imp(f"""
SELECT id, round({stat_sql('mean', HIST_A)} + {NUDGE}, 4) AS hist_a_mean, round({stat_sql('mean', HIST_B)} + {NUDGE}, 4) AS hist_b_mean
FROM imp""", "orders", "history"))
def hist_means(spark, sf):
    return impressions(spark, sf, "orders", "history").select(
        "id", r(H.row_mean(HIST_A), 4, "hist_a_mean", NUDGE), r(H.row_mean(HIST_B), 4, "hist_b_mean", NUDGE)
    )


CONFIGURED = {**GROUPS, "history_a": HIST_A, "history_b": HIST_B, "l_feat": L_FEAT}


def _configured():
    groups = DEFAULT["feature_engineering"]["aggregations"]["groups"]
    return [(name, cols, groups[name]["stats"]) for name, cols in CONFIGURED.items()]


@query("config_group_stats", with_imp("SELECT id, " + ", ".join(
    f"round(CAST(CAST({stat_sql(s, cols, 'FLOAT')} AS FLOAT) AS DOUBLE), 2) + 0.0 AS {name}_{s}"
    for name, cols, stats in _configured() for s in stats) + " FROM imp", *ALL))
def config_group_stats(spark, sf):
    """Float statistics for the groups and statistics of the settings."""
    settings = DEFAULT["feature_engineering"]["aggregations"]["groups"]
    df = features.aggregation_stage(impressions(spark, sf, *ALL), settings, DEFAULT["features"])
    return df.select("id", *[r(f"{name}_{s}", 2) for name, _, stats in _configured() for s in stats])


@query("line_item_stats", f"""
SELECT l_orderkey, l_linenumber, {stats_sql({'line': LINE}, ('mean', 'std', 'max', 'min', 'sum'))} FROM lineitem""")
def line_item_stats(spark, sf):
    """The same generator over the four measures of the largest table."""
    df = features.group_stats(table(spark, sf, "lineitem"), {"line": (LINE, H.STATS)})
    return df.select("l_orderkey", "l_linenumber", *made({"line": LINE}, ("mean", "std", "max", "min", "sum")))
