"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once over its whole input and written to Spark's no-op sink,
so that each output column is computed. The first query is run before timing
starts, to leave start-up out.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "ctr_by_segment", "tree_features", "deep_features", "two_stage_features", "config_group_stats", "line_item_stats",
    "seq_length_bin", "seq_diversity", "seq_vocabulary", "seq_encode", "seq_pad_mask", "candidate_match", "attention_pool",
    "freq_encode", "label_encode", "hash_cross", "stratified_folds", "noise_inject",
    "average_precision", "fold_metrics", "fold_median", "weighted_blend", "perf_blend",
    "boosted_trees_b", "crossed_linear",
)


def main(names: list[str]) -> None:
    from clickloom.plans.queries import REGISTRY
    from clickloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    chosen = names or list(HEADLINE)

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(chosen[0])
    times = {}
    for name in chosen:
        times[name] = run(name)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
