"""Captured DNS responses, the input of the health checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESPONSES = """
    server string, qname string, qtype string, attempt int, answered boolean, rcode int,
    n_answers int, rr_a array<string>, rr_aaaa array<string>, rr_cname array<string>,
    rr_ns array<string>, rr_mx array<string>, rr_txt array<string>, rr_ds array<string>,
    ttl_a bigint, auth_ns array<string>, auth_type string, sent_at timestamp, recv_at timestamp
"""

# Captures that still hold the records as text, one presentation line each.
RAW_RESPONSES = """
    server string, qname string, qtype string, attempt int, answered boolean, rcode int,
    answer array<string>, authority array<string>, sent_at timestamp, recv_at timestamp
"""


def scan_responses(
    spark: SparkSession, path: str, fmt: str = "parquet", raw: bool = False
) -> DataFrame:
    """Read a capture written as parquet or JSON."""
    return spark.read.format(fmt).schema(RAW_RESPONSES if raw else RESPONSES).load(path)


def probe_names(names: DataFrame, column: str = "domain") -> DataFrame:
    """Any table of names as a probe list: each name once."""
    return names.select(names[column].alias("domain")).distinct()
