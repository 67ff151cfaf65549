"""Time the headline queries: one warm-up run of each, then the median of the timed runs.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cleanloom.queries import catalog
from cleanloom.session import local_session

HEADLINE = [
    "rolling_features_long", "partitions_full_long", "holdout_split", "inject_exact", "impute_mean", "impute_median",
    "impute_mode", "impute_knn", "impute_chain", "noclean", "outlier_iqr", "clean_mad", "scale_zs", "scale_rs",
    "bins_quantile", "rank_ties", "label_encode", "ridge_grid", "metrics_regression", "partition_distance",
    "rank_difference", "performance_ratio", "group_matrix", "top_pairs", "search_fixed", "sweep",
]


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, "bench", shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm_folder = os.environ.get("BENCH_WARM_DIR", folder)
    seconds = {}
    for name in names:
        run(spark, warm_folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
