"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetsight.plans.catalog import QUERIES  # noqa: E402
from fleetsight.session import local_session  # noqa: E402

HEADLINE = [
    "a01b_snapshot_cycle",
    "a01_feature_stats_all_hosts",
    "a02_bucketed_metrics",
    "a03_kpis",
    "a05_severity_distribution",
    "a09_throughput",
    "a10_mean_gap",
    "a11_minute_trend",
    "a13_report_counters",
    "a18_host_summaries",
    "a19_signals",
    "a20_health_scores",
    "a_det_detected_errors",
    "a_rul_rule_candidates",
    "a_ups_rolled_up_alerts",
    "a_ups_alerts_with_acks",
    "c06_correlations",
    "f01_clean_documents",
    "f09_keyword_class_documents",
    "i01_incidents",
    "j01_fleet_list",
    "j02_failing_hosts",
    "j06_rule_matches",
    "j07_recent_matches",
    "j15_incident_timeline",
    "m02_isolation_forest",
    "m06_scoring_cycle_heuristic",
    "m07_forecasts",
    "m07_spend_regression",
    "p01_event_search",
    "s02_envelope_flatten",
    "s05_unseen_documents",
    "s16_chunk_messages",
    "t03_sliding_snapshots",
    "w01_host_gaps",
    "w03_latest_predictions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["a03_kpis"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executor threads
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
