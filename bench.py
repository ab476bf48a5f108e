"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the no-op sink (every row is
produced, nothing is collected to the driver).  Before timing, every headline
query runs once on the smallest driver dataset to warm the JVM (class loading,
JIT, the generated-code cache); the timed pass then runs on $BENCH_SF_DIR.
Prints one JSON line (``warmup_sec`` reports the warm-up pass).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from headroom.session import get_spark  # noqa: E402
from headroom.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "capacity_collision", "capacity_vs_demand", "quality_by_site_quarter", "headcount_vs_seats",
    "site_health", "space_demand", "space_collision", "time_to_seat", "plan_reconciliation",
    "forecast_accuracy", "material_changes", "kpi_scorecard", "cost_of_delay", "decision_queue",
    "queue_decisions", "relocation", "scenario_grid", "change_impact", "alert_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    t0 = time.perf_counter()
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "warmup_sec": warmup}))
    spark.stop()


if __name__ == "__main__":
    main()
