"""Headline timings as one JSON line. Every query is run from the given tables to the full result.

The first pass warms the JVM; the reported time is the second pass. ``aging_distribution`` to
``match_cascade`` compute everything anew; the cascade writes its own stage tables in both passes.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import catalog

HEADLINES = (
    "aging_distribution",
    "movement_categories",
    "client_identify",
    "exact_hits",
    "combos",
    "accumulated_hits",
    "reference_hits",
    "match_cascade",
    "full_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paidup-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # The steps expand small inputs by much work per byte: do not merge them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # A run has more generated classes than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for _ in range(2):
        for name in HEADLINES:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
