"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINES = (
    "pivot_median_orders",
    "pivot_sum_orders",
    "pivot_top_k_brand",
    "value_counts_lineitem",
    "missingness_graded",
    "numeric_profile_lineitem",
    "histogram_lineitem",
    "variability_scores_flow",
    "quality_findings_graded",
    "outlier_columns_lineitem",
    "merge_report",
    "compare_categories",
    "correlation_matrix_gaps",
    "spearman_lineitem",
    "chi2_pairs_lineitem",
    "group_tests_flow",
    "regression_label_terms",
    "heuristic_metrics_flow",
    "segment_report_flow",
    "density_clusters_flow",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from queries import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    queries, seconds = all_queries(), {}
    for name in HEADLINES:
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
