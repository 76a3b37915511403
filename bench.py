"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tallyweave.catalog.queries import QUERIES

HEADLINE = [
    "ledger_view",
    "match_exact_id",
    "vendor_candidates",
    "knn_topk",
    "knn_vendor_pool",
    "classify_rules",
    "reconcile_submissions",
    "detect_duplicates",
    "sequential_duplicates",
    "investigate",
    "approve_drafts",
    "review_history",
    "audit_partitioned_scan",
    "extract_fields",
    "extract_total",
    "assemble_lines",
    "bio_labels",
    "bio_spans",
    "span_metrics",
    "class_weights",
    "stratified_split",
    "error_summary",
    "repair_lift",
    "eval_retrieval",
    "eval_end_to_end",
    "eval_heldout",
    "stream_reconcile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["scenario_counts"](spark, folder).collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
