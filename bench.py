"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hazeflow import build_session  # noqa: E402
from hazeflow.catalog.registry import all_queries  # noqa: E402

HEADLINE = [
    "p2_build_features",
    "p2_build_features_raw",
    "p2_build_features_stations",
    "p2_backfill",
    "w1_rolling_mean_6h",
    "j2_asof_nearest_24h",
    "a1_null_audit",
    "a2_coverage",
    "a3_summary_stats",
    "w5_find_gaps_stations",
    "j4_missing_dates",
    "a7_correlation_matrix",
    "a8_box_stats_hour",
    "a10_linear_trend",
    "w6_forecast_target",
    "w7_chrono_split",
    "w8_ffill_bfill",
    "w10_make_sequences",
    "a5_evaluate",
    "a11_median_imputer",
    "j3_forecast_horizons",
    "m9_linear_attribution",
    "o2_latest_row",
    "o3_last_n",
    "w9_keep_last",
    "so1_parse_aqicn_current",
    "so5_parse_pollution_history",
    "sk2_upsert_features",
    "m1_grid_ridge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["a2_coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
