"""Time the headline queries and print one JSON line.

Each query is timed once, from building the plan to the last row, after one untimed query.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores), BENCH_QUERIES (optional
comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pulsefleet.plans import QUERIES
from pulsefleet.session import local_session

HEADLINE = (
    "e1_window_features",
    "e3_training_set_summary",
    "e4_rolling_means",
    "e6_robust_z",
    "e9_adaptive_baseline",
    "e11_episode_building",
    "e15_alert_hysteresis",
    "e21_grouped_temporal_split",
    "c12_asof_with_ttl",
    "h5_risk_fusion",
    "h6_process_classes",
    "f3_top_processes",
    "f4_best_candidate",
    "i2_criticality",
    "h9_action_impact",
    "d11_distribution_summary",
    "d16_comparison_report",
    "d23_slice_metrics",
    "d32_off_policy_evaluation",
    "d33_reward_statistics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus)
    # One untimed query starts the session, so that its start-up is not charged to the first name.
    QUERIES["e2_future_labels"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
