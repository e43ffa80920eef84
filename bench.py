"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Results are computed in full and thrown away (no-op sink). Each query runs once to warm up and then once
for the record.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from wellstream.plans.queries import run
from wellstream.session import SESSION_CONF

HEADLINES = [
    "s1_ingest_messages",
    "s3_store_status",
    "v1_reason_counts",
    "o2_store_status",
    "o4_sequence_status",
    "m1_outcome_counts",
    "o7_session_conflicts",
    "e8_event_stream",
    "m4_metrics_series",
    "h3_recent_readings_per_device",
    "q3_sequence_continuity",
    "l17_readings",
    "d2_displayed_readings",
    "b6_upgrade_counts",
]


def seconds(name: str, spark: SparkSession, sf_dir: str) -> float:
    started = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wellstream-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        seconds(name, spark, sf_dir)
        times[name] = round(seconds(name, spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
