"""Ordered lists per key, gathered in two steps so that no group of lines is unbounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonescope.operators.parse import STRIPE
from zonescope.plans.workspace import TASK_ROWS, tasks_for

#: Parts that keys are counted in, to size tasks and find out whether a key may be hot.
BUCKETS = 4096


def in_order(value: Column, order: str = "seq") -> Column:
    """Aggregate: the values of a group in the order of a column."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("value")))),
        lambda x: x["value"],
    )


def stripe_of(seq: Column, stripe: int = STRIPE) -> Column:
    return F.floor(seq / stripe)


def joined(
    items: DataFrame, keys: list[str], value: Column, sep: str = ",", stripe: int = STRIPE,
    head: Column | None = None,
) -> DataFrame:
    """(keys, value): the values of each key in line order, joined with ``sep``.

    The lines of a key are joined per stripe first, and then the texts of its stripes, so a hot key
    is sorted in pieces of at most ``stripe`` lines. ``head`` is a minimum that is carried along.
    """
    carried = [] if head is None else [head.alias("head")]
    pieces = items.groupBy(*keys, stripe_of(F.col("seq"), stripe).alias("stripe")).agg(
        F.array_join(in_order(value), sep).alias("piece"), *carried)
    return pieces.groupBy(*keys).agg(
        F.array_join(in_order(F.col("piece"), "stripe"), sep).alias("value"),
        *[F.min("head").alias("head") for _ in carried])


def least_by(
    rows: DataFrame, keys: list[str], value: str, order: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """(keys, value): the ``value`` with the least ``order`` of each key.

    Spark sorts rows for such an aggregate, whole scan partitions at first. Here rows are counted, dealt
    over tasks by key and sorted once, about ``task_rows`` at a time. If a bucket of keys holds more than
    that, one of its keys may be hot: then keys are aggregated in slices first.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    size = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    n, slices = tasks_for(rows.sparkSession, size["n"], task_rows), -(-size["most"] // task_rows)
    if slices > 1:
        rows = rows.withColumn("slice", F.monotonically_increasing_id() % slices).repartition(
            n, *keys, "slice").groupBy(*keys, "slice").agg(
            F.min_by(value, order).alias(value), F.min(order).alias(order))
    return rows.repartition(n, *keys).groupBy(*keys).agg(F.min_by(value, order).alias(value))
