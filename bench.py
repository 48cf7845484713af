"""Time the headline queries; prints one JSON line.

The dump, the ownership list and the captured responses are derived from the tables first and are
not timed. ``dump_parse`` reads the dump text anew; the reports read the record table that
``load_cache`` wrote, whose time is ``load_cache``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from zonescope.catalog import QUERIES
from zonescope.plans import derived

HEADLINE = (
    "dump_parse", "cache_summary", "spf_report", "txt_report", "mx_report", "ptr_report",
    "https_report", "svcb_params", "record_detail", "bulk_lookup", "single_ns", "ns_ip_list",
    "ns_ip_domains", "ip_attribution", "ns_ip_ownership", "probe_status", "failing_negatives",
    "ns_disagreement", "delegation_trace", "parent_child_mismatch",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("zonescope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        # The tables are small: cut them finely enough to keep all cores busy.
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    derived.dump_folder(spark, sf_dir)
    derived.captured(spark, sf_dir)
    lines = derived.dump(spark, sf_dir).lines.count()

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        begin = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - begin, 3)

    timed("load_cache", lambda: derived.cache(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, sf_dir)))
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "dump_lines": lines, "lines_per_sec": round(lines / times["dump_parse"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
