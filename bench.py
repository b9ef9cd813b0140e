"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores (default all).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "x05_series_with_change", "x11_signed_ranks", "k03_pair_correlation", "k04_lag_profile",
    "p04_nav_weight_mode", "p08_daily_metrics", "p12_attribution", "p24_scenarios",
    "c06_indicator_bundle", "c11_financial_ratios", "c20_health_scores",
    "n10_overall_relevance", "n13_deduplicated_all", "n15_final_selection", "n28_page_articles",
    "t06_glance_table", "t13_resolved_conflicts", "v09_canonical_industries",
    "q01_period_summaries", "q04_anomalies", "z01_daily_source_health",
]


def main() -> None:
    from tidemark.plans.all_queries import QUERIES
    from tidemark.runtime import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["x02_report_types"](spark, folder).collect()  # starts the JVM paths, not timed
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
