"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}. Each
query is executed to completion with the no-op sink (no collect to the
driver); the reported time per query is the best of $BENCH_REPEATS runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# the headline workload: panel integration, the imputation cascade, feature
# engineering, scaling, evaluation of all models, annualisation, hybrid
# adjustment, profiling statistics, neighbours and zonal aggregation
HEADLINE = [
    "flagship_yearly_change",
    "j08_fuzzy_name_match",
    "w07_impute_cascade_values",
    "w08_global_row_order_fill",
    "w09_impute_by_missing_share",
    "e04_e19_engineered_features",
    "e22_target_encoding_train_fit",
    "m01_robust_scale_train_fit",
    "v05_leaderboard_all_models",
    "a25_annualize_all_models",
    "h10_h17_parse_adjustments",
    "a12_describe",
    "a15_correlation_matrix",
    "q03_outliers_3iqr",
    "m33_knn_all_points",
    "z02_z03_zonal_mean_all_periods",
]
# timed and listed, but kept out of the total so that it stays comparable between rounds
EXTRA = ["w14_rank_all_orders", "a33_box_stats", "z04_nearest_site", "s09_keyed_text_files", "m25_s15_grid_search_cv",
         "a10_median_wide_decades_by_group", "m21_ridge_search_table", "m22_m28_forest_and_importances"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    from panelforge.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 4),
                          checkpoint_dir=tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    from panelforge.plans.catalog import QUERIES

    # warm the JVM (class loading, codegen caches) on an untimed query
    QUERIES["a07_coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE + EXTRA:
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec",
                      "with_extra_seconds": round(sum(times.values()), 3),
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
