"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from tallyloom.plans import catalog
from tallyloom.plans.derive import Graph

HEADLINE = [
    "providers_overview", "window_overlap_conversations", "graph_children_complete", "subagent_either_endpoint", "slice_sections", "semantic_token_calls", "headline_metrics",
    "active_time_merge", "peak_concurrency", "cohort_model", "rank_models", "calendar_activity", "token_series_by_model", "share_safe_dataset", "merge_rank_upsert", "retention_apply",
    "validate_violations", "turn_segmentation", "asof_usage_to_turn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executors' threads
    began = time.perf_counter()
    Graph(spark, sf_dir).store()  # the graph that all queries read, written once
    took["store_graph"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
