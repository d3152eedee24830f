"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs from raw tables to a full result (noop sink). After one warm-up round the
median of $BENCH_RUNS runs counts; caches are cleared between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prices_daily", "fundamentals", "fact_dedup", "filing_state", "ratios_daily", "metric_stats",
    "peer_median", "watchlist_grid", "edge_trigger", "rule_holds", "reconcile", "segment_growth",
    "upsert_latest",
]


def main() -> None:
    from tidemark.plans.queries import QUERIES
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(key: str) -> float:
        spark.catalog.clearCache()
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for key in keys:
        once(key)
        timings[key] = round(statistics.median(once(key) for _ in range(runs)), 3)
        print(f"{key} {timings[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
