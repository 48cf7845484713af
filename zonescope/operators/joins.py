"""Equi-join for a left side with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
    row_id: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join with the hot keys of ``left`` spread over several tasks.

    Keys with over ``rows_per_task`` left rows are found with a pre-aggregated count, or in
    ``counts`` (the keys and ``n``, the left rows of each) when the caller has them already. Their left
    rows get a salt from ``row_id`` and their right rows are repeated once per salt; all other
    keys join as usual. There are at most rows/rows_per_task hot keys, and Spark broadcasts that
    table only when its measured size is under the threshold of the session.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    hot = counts.filter(
        F.col("n") > rows_per_task
    ).select(*on, F.ceil(F.col("n") / rows_per_task).cast("int").alias("fan"))
    fan = F.coalesce("fan", F.lit(1))
    salted = left.join(hot, on, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*(row_id or left.columns)), fan).cast("int")).drop("fan")
    repeated = right.join(hot, on, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("fan")
    return salted.join(repeated, [*on, "salt"], how).drop("salt")
