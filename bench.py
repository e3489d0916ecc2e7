"""Time the headline queries: one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  Each query
runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_completeness", "quality_consistency", "quality_validity", "dist_numeric_summary", "dist_frequencies",
    "dist_histogram", "dist_density", "outliers_detect", "outliers_iqr", "outliers_consensus", "tests_welch_t",
    "tests_anova", "tests_chi_square", "tests_mann_whitney", "series_trend", "series_changepoints",
    "series_autocorrelation", "series_stationarity", "series_decompose_additive", "segments_scaled",
    "segments_cluster_summary", "segments_pca",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from plumbline.plans.queries import registry

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_WORK_DIR", "/tmp/plumbline-bench")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known = registry()

    def once(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
