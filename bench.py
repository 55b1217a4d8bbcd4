"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["scan_identifiers", "compress_3", "to_datacubes", "union", "subtract", "select_two", "axes", "partition_by_metadata", "resolve_metadata", "push_metadata", "union_metadata", "node_counts", "arena_nodes", "dss_import", "atoms_union", "atoms_billion"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cubeloom.queries import QUERIES

    seconds = {}
    for name in NAMES:
        best = []
        for _ in range(2):  # the first run also compiles code
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        seconds[name] = round(min(best), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
