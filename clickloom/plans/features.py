"""Feature plans: DataFrame in, DataFrame out, one projection per step.

Every step adds columns only where its inputs exist, looks at column names and
never starts a job. All steps except frequency encoding are row-local.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions import cross, history, horizontal, sequence, temporal, values
from ..operators.encode import freq_encode
from .config import DEFAULT, unwrap

# Column roles.
CATEGORICAL = (
    "gender", "inventory_id", "hour", "age_group", "day_of_week",
    "time_segment", "seq_length_bin_str", "age_hour",
)
RAW_CATEGORICAL = ("gender", "age_group", "inventory_id", "day_of_week", "hour")
BINARY = (
    "l_feat_1", "l_feat_2", "l_feat_8", "l_feat_13", "l_feat_16",
    "l_feat_19", "l_feat_21", "l_feat_22", "l_feat_24",
)
FREQUENCY = ("inventory_id", "age_group", "gender")
GROUPS = ("feat_a", "feat_b", "feat_c", "feat_d", "feat_e")
KEY, LABEL, SEQ = "id", "clicked", "seq"


# -- columns -----------------------------------------------------------------


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Raw columns of a group: ``<prefix>_<number>``."""
    return [c for c in df.columns if c.startswith(f"{prefix}_") and c[len(prefix) + 1 :].isdigit()]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (StringType, BooleanType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def feature_columns(df: DataFrame, exclude: Sequence[str] = (KEY, LABEL, SEQ)) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: nulls per column, in one aggregate."""
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in columns or df.columns])


def fill_missing(df: DataFrame, text_marker: str = "", number: float = 0) -> DataFrame:
    """Null and NaN to 0 in numeric columns, null to the marker in text columns."""
    return df.na.fill(number, subset=numeric_columns(df)).na.fill(text_marker, subset=text_columns(df))


# -- row-wise group statistics -------------------------------------------------


def group_stats(
    df: DataFrame, groups: Mapping[str, tuple[Sequence[str], Sequence[str]]], dtype: str = "double"
) -> DataFrame:
    """Add ``<name>_<stat>`` for several groups ``{name: (columns, stats)}`` in two projections.

    The deviation needs the mean of the row; it is computed once, in the first
    projection, instead of being repeated inside every squared difference.
    """
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    helpers: list[str] = []
    for name, (cols, stats) in groups.items():
        if not cols:
            continue
        if "std" in stats:
            mean, count = f"_{name}_mean", f"_{name}_count"
            first[mean], first[count] = horizontal.row_mean(cols, dtype), horizontal.row_count(cols)
            helpers += [mean, count]
            second[f"{name}_std"] = horizontal.row_std(cols, mean, count, dtype).cast(dtype)
        if "mean" in stats:
            made = F.col(f"_{name}_mean") if "std" in stats else horizontal.row_mean(cols, dtype)
            second[f"{name}_mean"] = made.cast(dtype)
        if "max" in stats:
            second[f"{name}_max"] = horizontal.row_max(cols, dtype).cast(dtype)
        if "min" in stats:
            second[f"{name}_min"] = horizontal.row_min(cols, dtype).cast(dtype)
        if "sum" in stats:
            second[f"{name}_sum"] = horizontal.row_sum(cols, dtype).cast(dtype)
    if not second:
        return df
    return df.withColumns(first).withColumns(second).drop(*helpers) if first else df.withColumns(second)


# -- plan 1: boosted trees A and B, sequence model -------------------------------


def sequence_features(df: DataFrame, edges: tuple[int, ...] = sequence.LENGTH_EDGES, boundary: bool = False) -> DataFrame:
    if SEQ not in df.columns:
        return df
    n = F.col("seq_length")
    df = df.withColumn("seq_length", sequence.length(SEQ))
    return df.withColumns(
        {
            "seq_length_clipped": sequence.length_clipped(n),
            "seq_length_log": sequence.length_log(n),
            "seq_length_bin": sequence.length_bin(n, edges),
            "seq_very_short": sequence.very_short(n),
            "seq_diversity_proxy": sequence.diversity_proxy(SEQ, n),
            **{f"seq_has_{x}": sequence.has_item(SEQ, x, boundary) for x in sequence.FREQUENT_ITEMS},
            "seq_length_bin_str": sequence.length_bin(n, edges).cast("string"),
        }
    )


def history_features(df: DataFrame) -> DataFrame:
    made: dict[str, Column] = {}
    if "history_a_1" in df.columns:
        h = "history_a_1"
        made |= {
            "history_a_1_clipped": history.rate_clipped(h),
            "history_a_1_log": history.rate_log(h),
            "history_a_1_bin": history.rate_bin(h),
            "history_a_1_high": history.above(h, history.RATE_HIGH),
            "history_a_1_very_high": history.above(h, history.RATE_VERY_HIGH),
        }
    if "history_a_4" in df.columns:
        h = "history_a_4"
        made |= {
            "history_a_4_clipped": history.depth_clipped(h),
            "history_a_4_near_zero": history.above(h, history.DEPTH_NEAR_ZERO),
            "history_a_4_bin": history.depth_bin(h),
        }
    cols = with_prefix(df, "history_a")
    df = df.withColumns(made) if made else df
    return group_stats(df, {"history_a": (cols, ("mean", "std", "max"))})


def time_features(df: DataFrame) -> DataFrame:
    made: dict[str, Column] = {}
    if "hour" in df.columns:
        hour = values.strict_int("hour")
        made |= {
            "time_segment": temporal.time_segment(hour),
            "is_dawn": temporal.is_dawn(hour),
            "is_morning_rush": temporal.is_morning_rush(hour),
        }
    if "day_of_week" in df.columns:
        day = values.strict_int("day_of_week")
        made |= {"is_tuesday": temporal.is_tuesday(day), "is_weekend": temporal.is_weekend(day, "sat_sun")}
    return df.withColumns(made) if made else df


def interaction_features(df: DataFrame) -> DataFrame:
    made: dict[str, Column] = {}
    if {"history_a_1", "seq_length"} <= set(df.columns):
        made |= {
            "h1_x_seqlen": cross.rate_by_length("history_a_1", "seq_length"),
            "h1_x_seqlen_log": cross.rate_by_length_log("history_a_1", "seq_length"),
        }
    if {"age_group", "hour"} <= set(df.columns):
        made["age_hour"] = cross.joined_text("age_group", "hour")
    return df.withColumns(made) if made else df


def feature_group_features(df: DataFrame) -> DataFrame:
    groups = {p: (with_prefix(df, p), ("mean", "max", "min", "std")) for p in GROUPS}
    feat_a = groups["feat_a"][0]
    df = group_stats(df, groups)
    if not feat_a:
        return df
    nonzero = horizontal.nonzero_count(feat_a)
    return df.withColumns({"feat_a_nonzero_count": nonzero, "feat_a_is_sparse": values.flag(nonzero == 0)})


def tree_features(df: DataFrame) -> DataFrame:
    """All row-local features of plan 1."""
    for step in (sequence_features, history_features, time_features, interaction_features, feature_group_features):
        df = df.transform(step)
    return df


def native_tree_inputs(df: DataFrame) -> DataFrame:
    """Categories as text with the missing marker, binary flags as 0/1."""
    made = {c: values.fill_text(c) for c in CATEGORICAL if c in df.columns}
    made |= {c: values.binary_flag(c) for c in BINARY if c in df.columns}
    return df.withColumns(made) if made else df


# -- plan 2: crossed linear model ------------------------------------------------


def deep_features(df: DataFrame) -> DataFrame:
    """Features of the crossed model: null history flags are 0 and a missing sequence has length 0."""
    made: dict[str, Column] = {}
    have = set(df.columns)
    if "history_a_1" in have:
        made |= {
            "history_a_1_log": history.rate_log("history_a_1"),
            "history_a_1_high": history.above("history_a_1", history.RATE_HIGH, 0),
            "history_a_1_very_high": history.above("history_a_1", history.RATE_VERY_HIGH, 0),
        }
    if "history_a_4" in have:
        made["history_a_4_near_zero"] = history.above("history_a_4", history.DEPTH_NEAR_ZERO, 0)
    if "hour" in have:
        hour = values.safe_int("hour")
        made |= {"is_dawn": temporal.is_dawn(hour), "is_morning_rush": temporal.is_morning_rush(hour)}
    if "day_of_week" in have:
        made["is_tuesday"] = temporal.is_tuesday(values.safe_int("day_of_week"))
    if SEQ in have:
        n = sequence.length(SEQ, null_length=0)
        unique = sequence.unique_count(SEQ)
        made |= {
            "seq_length": n,
            "seq_length_log": sequence.length_log(n),
            "seq_very_short": sequence.very_short(n),
            "seq_unique_count": unique,
            "seq_diversity": sequence.diversity(unique, n),
        }
    return df.withColumns(made) if made else df


# -- plan 3: two-stage features ----------------------------------------------------


def first_stage(df: DataFrame, frequency: Sequence[str] = FREQUENCY) -> DataFrame:
    """Time blocks, row statistics with population deviation, history shifts, crosses, frequencies."""
    have = set(df.columns)
    df = df.withColumns({c: values.safe_double(c) for c in ("hour", "day_of_week") if c in have})
    l_feat, hist_a, hist_b = (with_prefix(df, p) for p in ("l_feat", "history_a", "history_b"))
    made: dict[str, Column] = {}
    if "hour" in have:
        made |= {
            "hour_block": temporal.hour_block("hour"),
            "is_morning": temporal.is_morning("hour"),
            "is_evening": temporal.is_evening("hour"),
        }
    if "day_of_week" in have:
        made["is_weekend"] = temporal.is_weekend("day_of_week", "fri_sat")
    if {"hour", "day_of_week"} <= have:
        made["day_hour_cross"] = cross.day_hour("day_of_week", "hour")
    if l_feat:
        made |= {
            "l_feat_sum": horizontal.row_sum(l_feat),
            "l_feat_mean": horizontal.row_mean(l_feat),
            "l_feat_min": horizontal.row_min(l_feat),
            "l_feat_max": horizontal.row_max(l_feat),
        }
    if {"l_feat_1", "l_feat_14"} <= have:
        made["l_feat_ratio_1_14"] = values.ratio("l_feat_1", "l_feat_14")
    for name, short, cols in (("history_a", "hist_a", hist_a), ("history_b", "hist_b", hist_b)):
        if len(cols) >= 2:
            made[f"{short}_mean"] = horizontal.row_mean(cols)
        first, third = f"{name}_1", f"{name}_3"
        if {first, third} <= have:
            made |= {
                f"{short}_delta_13": history.delta(first, third),
                f"{short}_ratio_13": history.shift_ratio(first, third),
                f"{name}_trend": history.trend(first, third),
            }
    for name, other in (("inv_age_cross", "age_group"), ("inv_gender_cross", "gender")):
        if {"inventory_id", other} <= have:
            made[name] = cross.joined_text("inventory_id", other)
    if {"inventory_id", "hour"} <= have:
        made["inv_hour_cross"] = cross.joined_text("inventory_id", temporal.hour_block("hour"))
    df = df.withColumns(made) if made else df
    if l_feat:
        df = df.withColumn("l_feat_std", horizontal.row_std_population(l_feat, "l_feat_mean"))
        spread = F.col("l_feat_std")
        df = df.withColumns(
            {
                "l_feat_zmax": values.ratio(F.col("l_feat_max") - F.col("l_feat_mean"), spread),
                "l_feat_zmin": values.ratio(F.col("l_feat_min") - F.col("l_feat_mean"), spread),
            }
        )
    encoded = [c for c in frequency if c in have]
    df = freq_encode(df, encoded) if encoded else df
    df = df.withColumns({c: values.fill_text(c) for c in RAW_CATEGORICAL if c in have})
    return df.drop(SEQ).na.fill(0, subset=numeric_columns(df))


def temporal_stage(df: DataFrame, settings: Mapping) -> DataFrame:
    if not settings.get("enabled"):
        return df
    made: dict[str, Column] = {}
    have = set(df.columns)
    if "hour" in have and "hour_bins" in settings:
        made["hour_period"] = temporal.hour_period("hour", tuple(settings["hour_bins"]))
    if "day_of_week" in have and settings.get("weekend_flag"):
        made["is_weekend"] = temporal.is_weekend("day_of_week", "from_fri")
    if "hour" in have and settings.get("time_of_day_features"):
        made |= {
            "hour_sin": temporal.hour_sin("hour").cast("float"),
            "hour_cos": temporal.hour_cos("hour").cast("float"),
        }
    return df.withColumns(made) if made else df


def cross_stage(df: DataFrame, settings: Mapping) -> DataFrame:
    if not settings.get("enabled"):
        return df
    buckets = settings.get("num_buckets", cross.HASH_BUCKETS)
    made = {
        f"cross_{a}_{b}": cross.hash_cross(a, b, buckets)
        for a, b in settings.get("pairs", [])
        if {a, b} <= set(df.columns)
    }
    return df.withColumns(made) if made else df


def aggregation_stage(df: DataFrame, groups: Mapping, numbers: Mapping) -> DataFrame:
    """Float statistics per configured group; names of stage 1 are overwritten."""
    have = set(df.columns)
    chosen = {}
    for name, settings in groups.items():
        cols = [f"{name}_{i}" for i in numbers.get(name, []) if f"{name}_{i}" in have]
        chosen[name] = (cols, settings.get("stats", []))
    return group_stats(df, chosen, "float")


def second_stage(df: DataFrame, config: Mapping = DEFAULT) -> DataFrame:
    """Config-driven time, cross and group features, then missing values to 0 and empty text."""
    config = unwrap(config)
    settings = config.get("feature_engineering", {})
    df = df.withColumns(
        {
            c: kind
            for c, kind in (("hour", values.safe_double("hour").cast("float")), ("day_of_week", values.safe_int("day_of_week")))
            if c in df.columns
        }
    )
    if settings.get("enabled"):
        df = temporal_stage(df, settings.get("temporal", {}))
        df = cross_stage(df, settings.get("cross_features", {}))
        aggregations = settings.get("aggregations", {})
        if aggregations.get("enabled"):
            df = aggregation_stage(df, aggregations.get("groups", {}), config.get("features", {}))
    return fill_missing(df)


def two_stage_features(df: DataFrame, config: Mapping = DEFAULT) -> DataFrame:
    return second_stage(first_stage(df), config)
