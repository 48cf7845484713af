"""The tables of a resolver cache, parsed from a dump and written once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope.operators import parse
from zonescope.plans.workspace import tasks_for, written
from zonescope.sources.dump import Dump, scan_dump


RUN = 1 << 8  # neighbouring lines that stay together, as they compress well


class Cache(NamedTuple):
    records: DataFrame
    domains: DataFrame
    negatives: DataFrame


def build_cache(dump: Dump, compat: bool = True) -> Cache:
    """Parse a dump into written tables.

    The resolved lines are written first, so the text is parsed once for records and domains.
    Records are dealt over tasks by their number and sorted by type and domain inside each file: no
    task sorts more than its share, and a report on one type, or a lookup of one domain, skips the other row groups and pages. Domains have Bloom filters, so a lookup opens
    no row group without its domain, whatever the range of names there.
    """
    resolved = written(
        parse.resolved_lines(parse.line_states(dump, compat), compat), "resolved")
    records = written(
        parse.records(resolved, compat).repartition(
            tasks_for(resolved.sparkSession, resolved.count()), "source", F.floor(F.col("seq") / RUN)
        ).sortWithinPartitions("rtype", "domain", "seq"), "records", look_up="domain")
    domains = written(parse.domains(resolved).sortWithinPartitions("domain"), "domains",
                      look_up="domain")
    negatives = written(parse.negatives(records), "negatives")
    return Cache(records, domains, negatives)


def load_cache(
    spark: SparkSession, path: str, source: str = "file", compat: bool = True
) -> Cache:
    return build_cache(scan_dump(spark, path, source), compat)
