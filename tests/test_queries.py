"""Every registered query against its SQL, and the shape of the plans that matter."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from zonescope.catalog import QUERIES
from zonescope.operators import addresses, health, reports
from zonescope.oracles import ORACLES
from zonescope.plans import derived
from zonescope.plans.workspace import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def cell(x):
        if pd.isna(x):
            return "NULL"
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry_point.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark):
    cache, captured = derived.cache(spark, SF), derived.captured(spark, SF)
    found = addresses.ns_addresses(cache.records)
    networks = addresses.range_networks(derived.ranges(spark, SF))
    for df in (found, addresses.ns_ownership(found, networks), addresses.ip_domains(found),
               health.ns_disagreement(cache.records, captured, derived.RESOLVER),
               health.failing_negatives(cache.negatives, captured, derived.RESOLVER)):
        assert not re.search("NestedLoop|Cartesian", plan(df))


def test_filters_and_columns_reach_the_scan(spark):
    records = derived.cache(spark, SF).records
    text = plan(reports.spf_report(records))
    assert "EqualTo(rtype,TXT)" in text and "StringContains(rdata,v=spf)" in text
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans and all("wire" not in s and "attribute" not in s for s in scans)
    assert "EqualTo(domain,z1.example.)" in plan(reports.point_lookup(
        "z1.example.", records, derived.cache(spark, SF).domains))


def test_reports_need_no_join_or_window(spark):
    records = derived.cache(spark, SF).records
    for report in (reports.spf_report, reports.txt_report, reports.mx_report, reports.ptr_report):
        text = plan(report(records))
        assert not re.search("Join|Window", text) and text.count("Exchange hash") <= 2


def rows_scanned(df):
    """Rows that the scans of a query gave, after row groups were skipped."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_a_lookup_opens_few_row_groups(spark):
    names = spark.range(200_000).select(F.concat(
        F.md5(F.col("id").cast("string")), F.lit(".")).alias("domain"), F.lit("x" * 40).alias("rdata"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 27)
    plain = written(names.repartition(4), "plain")
    indexed = written(names.repartition(4), "indexed", look_up="domain")
    there, absent = names.first().domain, "nobody."
    look = lambda table, name: table.filter(F.col("domain") == name)
    inside = "8" * 31 + "."  # between the least and the greatest name of every file
    assert rows_scanned(look(plain, inside)) == 200_000
    assert rows_scanned(look(indexed, inside)) <= 60_000
    assert rows_scanned(look(indexed, absent)) == 0
    assert look(indexed, there).count() == 1 and rows_scanned(look(indexed, there)) <= 120_000
