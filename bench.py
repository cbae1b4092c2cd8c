"""Headline queries, timed.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is built and written to the ``noop`` sink in one warm session; its time includes planning
and any lineage cut it makes.  BENCH_RUNS repeats each query and keeps the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spendgrid.catalog import all_queries
from spendgrid.session import local_session

HEADLINE = (
    "vendor_top10", "outliers", "recurring_vendors", "subscription_detail", "category_savings", "cash_flow",
    "clean_full", "reduction_ratio", "train_model", "classify_transactions", "knn_top5", "transfers",
    "group_similarity", "group_dbscan", "group_hierarchical", "group_fuzzy", "group_similarity_by_user",
    "categorise_universal", "grouping_grid", "api_key_chain", "job_status", "stream_usage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g", app="spendgrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["vendor_top10"](spark, folder).limit(1).collect()  # warm up the session
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
