"""Time the headline queries on local[N] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from bolide.plans import catalog  # noqa: E402

HEADLINE = [
    "scan_rocks",
    "to_cartesian",
    "collisions_of_rock",
    "candidate_hits",
    "ordered_matching",
    "first_hit_per_rock",
    "hits_named",
    "contention_ranks",
    "mutual_first",
    "rocks_at",
    "active_objects",
    "observe_octant",
    "impacts",
    "top_oldest_rocks",
    "what_if_slug",
    "cascade_hits",
    "two_point_fit",
    "sample_trajectory",
    "history_intervals",
    "history_as_of",
    "history_as_of_join",
    "validate_requests",
    "rate_limit_violations",
    "short_names",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bolide-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
