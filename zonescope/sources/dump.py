"""Reader for cache dump text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope import constants as C

SPLIT = ["file_key", "block_start"]


class Dump(NamedTuple):
    """``lines``: file_key, block_start, mid, line. ``files``: file_key, file, source.

    ``file_key`` and ``block_start`` name one input split. ``mid`` orders the lines of a split and
    counts up by one inside it, empty lines included; the splits of a source are ordered by file and
    ``block_start``. Lines carry a file hash, not the path, so that the path
    is not shuffled with every line.
    """

    lines: DataFrame
    files: DataFrame


def _path(column: Column) -> Column:
    """One spelling for ``file:/x`` and ``file:///x``."""
    return F.regexp_replace(column, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def bounded_line(line: Column, limit: int) -> Column:
    """The line, or an error when it has more than ``limit`` bytes."""
    return F.when(
        F.octet_length(line) > limit, F.raise_error(F.lit(f"line longer than {limit} bytes"))
    ).otherwise(line)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text cut at line feeds only, with the split each line came from."""
    return (
        spark.read.option("lineSep", "\n").text(path)
        .select(
            F.col("value").alias("line"),
            _path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )


def scan_dump(
    spark: SparkSession, path: str, source: str = "file", on_long_line: str = "fail"
) -> Dump:
    """Read one dump, a glob or a folder of dumps.

    ``source="file"``: every file is a dump of its own. ``source="directory"``: the files of a
    folder, in name order, are the pieces of one dump. Parsing state never leaves a source.
    ``on_long_line``: ``fail`` stops at a line over the limit, ``keep`` reads it.
    """
    raw = text_lines(spark, path)
    names = spark.createDataFrame(
        [(name,) for name in spark.read.text(path).inputFiles()], "file string"
    ).select(_path(F.col("file")).alias("file"))
    folder = F.regexp_replace("file", r"/[^/]*\z", "")
    files = names.select(
        F.xxhash64("file").alias("file_key"), "file",
        (folder if source == "directory" else F.col("file")).alias("source"),
    )
    clash = files.groupBy("file_key").count().filter("count > 1")
    if not clash.isEmpty():
        raise ValueError("two input files share a hash: rename one of them")
    line = F.col("line")
    if on_long_line == "fail":
        line = bounded_line(line, C.MAX_DUMP_LINE)
    lines = raw.select(
        F.xxhash64("file").alias("file_key"), "block_start",
        F.monotonically_increasing_id().alias("mid"),
        F.regexp_replace(line, r"\r\z", "").alias("line"),
    ).filter("line <> ''")
    return Dump(lines, files)


def long_lines(spark: SparkSession, path: str, limit: int = C.MAX_DUMP_LINE) -> DataFrame:
    """Where the lines over the limit are, for a look before a run."""
    return text_lines(spark, path).filter(F.octet_length("line") > limit).select(
        "file", "block_start", F.octet_length("line").alias("n_bytes")
    )
