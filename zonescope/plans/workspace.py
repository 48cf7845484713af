"""Written tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one when it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="zonescope-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for one written table."""
    return f"{shared_dir(spark)}/zonescope/{name}-{uuid.uuid4().hex}"


#: Rows that one task may sort, and rows that are too few for a task of their own.
TASK_ROWS, FEW_ROWS = 1 << 18, 1 << 14


def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """The tasks that ``rows`` are dealt over: as many as the session has shuffle partitions, fewer
    for few rows, and more where a task would hold over ``task_rows``.

    Compressed bytes, by which Spark cuts scans and joins shuffle partitions, say little about the
    memory that a sort of their rows takes.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // task_rows), min(partitions, -(-rows // FEW_ROWS)))


def written(
    df: DataFrame, name: str, look_up: str | None = None, parts: str | None = None,
) -> DataFrame:
    """Write ``df`` as parquet and read it back: work is done once and survives lost executors.

    ``look_up`` names a column that gets Bloom filters, so that a search for one value opens only the
    row groups that may hold it; ``parts`` names the last column, by whose values files are apart.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write
    if look_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{look_up}", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true")
    if parts:
        writer = writer.partitionBy(parts)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
