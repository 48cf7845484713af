"""Reader for ownership lists: ``<range> ... <client>`` per line, single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope import constants as C
from zonescope.sources.dump import bounded_line, text_lines


def scan_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, range, client). ``line_no`` is (file, block, place) and so in file order."""
    lines = text_lines(spark, path).select(
        F.struct("file", "block_start", F.monotonically_increasing_id().alias("place")).alias(
            "line_no"),
        F.regexp_replace(bounded_line(F.col("line"), C.MAX_RANGE_LINE), r"\r\z", "").alias("line"),
    )
    return split_ranges(lines)


def split_ranges(lines: DataFrame) -> DataFrame:
    """(line_no, line) -> (line_no, range, client): the first and the last word of the line."""
    words = F.split("line", " ")
    return lines.select(
        "line_no", F.element_at(words, 1).alias("range"), F.element_at(words, -1).alias("client")
    )
