"""Settings of the two-stage features as a plain dict."""

from __future__ import annotations

from collections.abc import Mapping

# Column groups, statistics per group, hour bins and training settings.
DEFAULT = {
    "features": {
        "categorical": ["gender", "age_group", "inventory_id", "day_of_week", "hour"],
        "feat_a": list(range(1, 19)),
        "feat_b": list(range(1, 7)),
        "feat_c": list(range(1, 9)),
        "feat_d": list(range(1, 7)),
        "feat_e": list(range(1, 11)),
        "history_a": list(range(1, 8)),
        "history_b": list(range(1, 31)),
        "l_feat": list(range(1, 28)),
    },
    "feature_engineering": {
        "enabled": True,
        "aggregations": {
            "enabled": True,
            "groups": {
                "feat_a": {"stats": ["sum", "mean", "std"]},
                "feat_b": {"stats": ["sum", "mean"]},
                "feat_c": {"stats": ["sum", "mean"]},
                "feat_d": {"stats": ["sum", "mean"]},
                "feat_e": {"stats": ["sum", "mean"]},
                "history_a": {"stats": ["mean", "std", "max", "min"]},
                "history_b": {"stats": ["mean", "std", "max", "min"]},
                "l_feat": {"stats": ["mean", "std", "max", "min", "sum"]},
            },
        },
        "cross_features": {"enabled": False, "pairs": [], "num_buckets": 100_000},
        "temporal": {
            "enabled": True,
            "hour_bins": [0, 6, 12, 18, 24],
            "weekend_flag": True,
            "time_of_day_features": True,
        },
    },
    "training": {"n_folds": 5, "seed": 42},
}


def unwrap(config: Mapping) -> dict:
    """Accept settings whose sections sit under a ``value`` key."""
    return {
        name: section["value"] if isinstance(section, Mapping) and set(section) >= {"value"} else section
        for name, section in config.items()
    }
