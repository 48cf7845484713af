"""Report lines and the text files that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.functions.text import bracketed
from zonescope.plans.workspace import written


def bar_lines(report: DataFrame, *columns: str) -> DataFrame:
    """The columns joined with bars, NULL as nothing."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return report.select("source", F.concat_ws("|", *cells).alias("line"))


def report_lines(report: DataFrame) -> DataFrame:
    return bar_lines(report, "domain", "value")


def ip_lines(ips: DataFrame) -> DataFrame:
    return ips.select("source", F.col("ip").alias("line"))


def ownership_lines(ownership: DataFrame) -> DataFrame:
    """CSV without quoting; ``place`` 0 is the header line of each source."""
    rows = ownership.select("source", F.lit(1).alias("place"), F.concat_ws(
        ",", "client", "ip", F.col("n_domains").cast("string"), "domains").alias("line"))
    header = ownership.select("source").distinct().select(
        "source", F.lit(0).alias("place"), F.lit(C.OWNERSHIP_HEADER).alias("line"))
    return header.unionByName(rows)


def failing_lines(failing: DataFrame) -> DataFrame:
    return bar_lines(failing, "status", "domain")


def parent_child_lines(mismatch: DataFrame) -> DataFrame:
    return mismatch.select("source", F.concat_ws(
        "|", "domain", bracketed(F.col("child_ns")), bracketed(F.col("parent_ns"))).alias("line"))


def disagreement_lines(disagreement: DataFrame, resolver: str) -> DataFrame:
    """One block of lines per domain: the expected answer, one line per odd name server, a blank.

    A name-server line does not name its domain: its place in the block does. The lines are single
    rows with a place (0 for the head line), so a domain with very many is never gathered.
    """
    def result(server, a, cname):
        return F.format_string(C.NS_RESULT, server, bracketed(a), bracketed(cname))

    heads = disagreement.groupBy("source", "domain").agg(
        F.first("expected_a").alias("a"), F.first("expected_cname").alias("c"),
        F.max("seq").alias("last"))
    head = F.concat("domain", F.lit(C.NS_DIFFERS), result(F.lit(resolver), F.col("a"), F.col("c")))
    ends = F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("place"), head.alias("line")),
        F.struct((F.col("last") + 1).alias("place"), F.lit("").alias("line")))).alias("end")
    outer = heads.select("source", "domain", ends).select("source", "domain", "end.*")
    indent = F.repeat(F.lit(" "), F.octet_length("domain") + 10)
    odd = disagreement.select("source", "domain", F.col("seq").alias("place"), F.concat(
        indent, result(F.col("ns"), F.col("actual_a"), F.col("actual_cname"))).alias("line"))
    return outer.unionByName(odd)


#: Lines of a source that one file holds, about.
LINES_PER_FILE = 1_000_000


def dealt(lines: DataFrame, lines_per_file: int) -> DataFrame:
    """The lines of a source in one task, or in as many as it has files to fill: small sources share
    tasks, and no task writes into the folder of a source that another one writes alone."""
    files = lines.groupBy("source").agg(
        F.ceil(F.count("*") / lines_per_file).cast("int").alias("files")).filter("files > 1")
    piece = F.pmod(F.xxhash64("line", F.monotonically_increasing_id()), F.coalesce("files", F.lit(1)))
    return lines.join(files, "source", "left").withColumn("piece", piece).repartition(
        "source", "piece")


def write_lines(
    lines: DataFrame, path: str, run: str, lines_per_file: int = LINES_PER_FILE,
    counted: Observation | None = None,
) -> str:
    """Write the lines under ``path/run=<run>``, a folder ``source=<source>`` for each dump.

    Lines with a ``place`` are written in order: by source, domain where they have one, and place,
    through the files of a source in name order. Others are counted first, so that files follow the size of
    a source and not the number of tasks. ``counted`` gets ``n_lines`` as the lines are written, without
    another pass. The file ``_SUCCESS`` ends a complete run. Returns the folder of the run.
    """
    folder = f"{path}/run={run}"
    order = [c for c in ("source", "domain", "place") if c in lines.columns]
    if "place" in order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        lines = dealt(written(lines.select("source", "line"), "lines"), lines_per_file)
    if counted is not None:
        lines = lines.observe(counted, F.count("*").alias("n_lines"))
    lines.select("source", "line").write.partitionBy("source").text(folder)
    return folder
