"""The three feature plans with every column they add.

A column has a kind that says how both engines show it: i whole numbers, t texts, d doubles to four digits, e to six, q to three, f floats to two, g floats to five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.impressions import impressions
from .. import features
from .horizontal import ALL, CONFIGURED, GROUPS, HIST_A, HIST_B, L_FEAT, MEAN, SPREAD, _configured, stat_sql
from .registry import NUDGE, query, r, with_imp

DIGITS = {"d": 4, "e": 6, "q": 3, "f": 2, "g": 5}


def _shown(name: str, kind: str, expr: str) -> str:
    if kind == "t":
        return f"{expr} AS {name}"
    if kind == "i":
        return f"CAST({expr} AS BIGINT) AS {name}"
    value = f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)" if kind in "fg" else f"CAST({expr} AS DOUBLE)"
    return f"round({value}{f' + {NUDGE}' if kind == 'd' else ''}, {DIGITS[kind]}) + 0.0 AS {name}"


def _sql(columns: dict[str, tuple[str, str]], rows: str, *parts: str) -> str:
    return with_imp(f"SELECT id, {', '.join(_shown(n, k, e) for n, (k, e) in columns.items())} FROM ({rows}) x", *parts)


def _same(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    def shown(name: str, kind: str):
        if kind == "t":
            return F.col(name)
        if kind == "i":
            return F.col(name).cast("bigint").alias(name)
        return r(name, DIGITS[kind], nudge=NUDGE if kind == "d" else 0.0)

    return df.select("id", *[shown(n, k) for n, (k, _) in columns.items()])


def _bins(value: str, *edges: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {e}::DOUBLE THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


LENGTH_BIN = _bins("n", "100", "200", "500", "1000")
TREE = {
    "seq_length": ("i", "n"), "seq_length_clipped": ("i", "CASE WHEN n > 5000 THEN 5000 ELSE n END"), "seq_length_log": ("e", "ln(1 + n)"), "seq_length_bin": ("i", LENGTH_BIN),
    "seq_very_short": ("i", "n <= 100"), "seq_diversity_proxy": ("e", "CAST(length(seq) AS DOUBLE) / (n * 3 + 1)"), "seq_length_bin_str": ("t", f"CAST({LENGTH_BIN} AS VARCHAR)"),
    **{f"seq_has_{x}": ("i", f"contains(seq, ',{x},')") for x in (74, 101, 479, 57, 408)},
    "history_a_1_clipped": ("e", "CASE WHEN history_a_1 > 10 THEN 10 ELSE history_a_1 END"), "history_a_1_log": ("e", "ln(1 + coalesce(history_a_1, 0))"),
    "history_a_1_bin": ("i", _bins("history_a_1", "0.05", "0.1", "0.2", "1.0")), "history_a_1_high": ("i", "history_a_1 > 0.2::DOUBLE"), "history_a_1_very_high": ("i", "history_a_1 > 1.0::DOUBLE"),
    "history_a_4_clipped": ("d", "CASE WHEN history_a_4 < -5000 THEN -5000 ELSE history_a_4 END"), "history_a_4_near_zero": ("i", "history_a_4 > -200"),
    "history_a_4_bin": ("i", _bins("history_a_4", "-1000", "-500", "-200")), **{f"history_a_{s}": ("d", stat_sql(s, HIST_A)) for s in ("std", "mean", "max")},
    "time_segment": ("t", "CASE WHEN h IN (2, 3, 4) THEN 'dawn' WHEN h IN (0, 1) THEN 'midnight' WHEN h IN (5, 6) THEN 'early' WHEN h <= 11 THEN 'morning' WHEN h <= 17 THEN 'afternoon' WHEN h <= 20 THEN 'evening' WHEN h <= 23 THEN 'night' ELSE 'other' END"),
    "is_dawn": ("i", "h IN (2, 3, 4)"), "is_morning_rush": ("i", "h BETWEEN 7 AND 10"), "is_tuesday": ("i", "d = 2"), "is_weekend": ("i", "d >= 6"),
    "h1_x_seqlen": ("d", "history_a_1 * ln(1 + n)"), "h1_x_seqlen_log": ("d", "ln(2 + history_a_1 * ln(1 + n))"), "age_hour": ("t", 'age_group || \'_\' || "hour"'),
    **{f"{g}_{s}": ("d", stat_sql(s, cols)) for g, cols in GROUPS.items() for s in ("mean", "max", "min", "std")},
    "feat_a_nonzero_count": ("i", " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in GROUPS["feat_a"])),
    "feat_a_is_sparse": ("i", "(" + " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in GROUPS["feat_a"]) + ") = 0"),
}
ROWS = 'SELECT *, len(string_split(seq, \',\')) AS n, CAST("hour" AS INTEGER) AS h, CAST(day_of_week AS INTEGER) AS d FROM imp'


@query("tree_features_wide", _sql(TREE, ROWS, *ALL, "seq"))
def tree_features_wide(spark, sf):
    """Plan 1: every column it adds."""
    return _same(features.tree_features(impressions(spark, sf, *ALL, "seq")), TREE)


ZERO_LENGTH = ROWS.replace("len(string_split(seq, ',')) AS n", "coalesce(len(string_split(seq, ',')), 0) AS n, coalesce(len(list_distinct(string_split(seq, ','))), 0) AS u")
DEEP = {
    "history_a_1_log": ("e", "ln(1 + coalesce(history_a_1, 0))"), "history_a_1_high": ("i", "coalesce(history_a_1 > 0.2::DOUBLE, false)"), "history_a_1_very_high": ("i", "coalesce(history_a_1 > 1.0::DOUBLE, false)"),
    "history_a_4_near_zero": ("i", "coalesce(history_a_4 > -200, false)"), "is_dawn": ("i", "h IN (2, 3, 4)"), "is_morning_rush": ("i", "h BETWEEN 7 AND 10"), "is_tuesday": ("i", "d = 2"),
    "seq_length": ("i", "n"), "seq_length_log": ("e", "ln(1 + n)"), "seq_very_short": ("i", "n <= 100"), "seq_unique_count": ("i", "u"), "seq_diversity": ("e", "u / CAST(n + 1 AS DOUBLE)"),
}


@query("deep_features_wide", _sql(DEEP, ZERO_LENGTH, *ALL, "seq"))
def deep_features_wide(spark, sf):
    """Plan 2: every column it adds."""
    return _same(features.deep_features(impressions(spark, sf, *ALL, "seq")), DEEP)


def _history(name: str, short: str, cols) -> dict[str, tuple[str, str]]:
    first, third = cols[0], cols[2]
    return {
        f"{short}_mean": ("d", f"coalesce({stat_sql('mean', cols)}, 0)"), f"{short}_delta_13": ("d", f"coalesce({first} - {third}, 0)"),
        f"{short}_ratio_13": ("q", f"coalesce({first} / ({third} + 1e-6), 0)"), f"{name}_trend": ("i", f"coalesce(sign({first} - {third}), 0)"),
    }


BLOCK = "CAST(floor(h / 4) AS VARCHAR)"
TWO_STAGE = {
    **{c: ("t", f"coalesce({c}, '__MISSING__')") for c in ("gender", "age_group", "inventory_id")}, "hour": ("f", "h"), "day_of_week": ("i", "d"),
    "hour_block": ("t", BLOCK), "is_morning": ("i", "h >= 6 AND h < 12"), "is_evening": ("i", "h >= 18 AND h < 24"), "is_weekend": ("i", "d >= 5"), "day_hour_cross": ("t", f"CAST(d AS VARCHAR) || '_' || {BLOCK}"),
    "l_feat_ratio_1_14": ("d", "coalesce(CAST(l_feat_1 AS DOUBLE) / (l_feat_14 + 1e-6), 0)"),
    "l_feat_zmax": ("d", f"coalesce(({stat_sql('max', L_FEAT)} - {MEAN}) / ({SPREAD} + 1e-6), 0)"), "l_feat_zmin": ("d", f"coalesce(({stat_sql('min', L_FEAT)} - {MEAN}) / ({SPREAD} + 1e-6), 0)"),
    **_history("history_a", "hist_a", HIST_A), **_history("history_b", "hist_b", HIST_B),
    "inv_age_cross": ("t", "coalesce(inventory_id || '_' || age_group, '')"), "inv_gender_cross": ("t", "coalesce(inventory_id || '_' || gender, '')"), "inv_hour_cross": ("t", f"coalesce(inventory_id || '_' || {BLOCK}, '')"),
    **{f"{c}_freq": ("e", f"CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {c}) / CAST(count(*) OVER () AS DOUBLE) END") for c in ("inventory_id", "age_group", "gender")},
    "hour_period": ("i", "CASE WHEN h < 6 THEN 0 WHEN h < 12 THEN 1 WHEN h < 18 THEN 2 ELSE 3 END"), "hour_sin": ("g", "sin(h * 2 * pi() / 24)"), "hour_cos": ("g", "cos(h * 2 * pi() / 24)"),
    **{f"{name}_{s}": ("f", stat_sql(s, [f"coalesce({c}, 0)" for c in cols], "FLOAT")) for name, cols, stats in _configured() for s in stats},
    **{c: ("d", f"coalesce({c}, 0)") for cols in CONFIGURED.values() for c in cols},
}


@query("two_stage_features_wide", _sql(TWO_STAGE, 'SELECT *, CAST("hour" AS DOUBLE) AS h, CAST(day_of_week AS DOUBLE) AS d FROM imp', *ALL))
def two_stage_features_wide(spark, sf):
    """Plan 3: every column it adds or changes, and the numbers it fills."""
    return _same(features.two_stage_features(impressions(spark, sf, *ALL)), TWO_STAGE)
