"""Times the headline queries: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (threads). Prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import workload  # noqa: E402

HEADLINE = [
    "sanitized_chats",
    "sanitizing_summary",
    "prose_claims",
    "contradiction_groups",
    "merge_verdict",
    "citation_gate",
    "url_gate",
    "recency_gate",
    "agent_states",
    "run_statuses",
    "question_snapshot",
    "track_registry",
    "shared_passages",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docaudit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "3"))):
            start = time.perf_counter()
            workload.RUNS[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    total = round(sum(took.values()), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline queries, median of repeats, total", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
