"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 4)
BENCH_RUNS     timed runs per query after one warm-up run (default 1; the median counts)
BENCH_QUERIES  comma-separated names instead of the headline set, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from forecourt.plans import ENTRIES
from forecourt.session import local_session

HEADLINE = [
    "price_by_make", "top_models_remeasured", "top_states_by_price", "transmission_share", "segment_stats_by_make",
    "market_stats_by_make_model_year", "installment_stats", "financing_by_dollar_range", "competition_by_make",
    "comparable_listings", "price_ledger", "audit_ledger", "total_price_from_text", "clean_view", "feature_table",
    "numeric_metrics", "category_metrics", "numeric_drift", "category_drift", "iqr_outliers", "robust_prices",
    "rolling_events_price_mean", "similar_listings", "bi_measures_by_year", "neighbour_fill", "demand_forecasts", "price_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(ENTRIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "4")), app="forecourt-bench")
    took: dict[str, float] = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            began = time.perf_counter()
            ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
        print(f"{name}: {took[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total_sec", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
