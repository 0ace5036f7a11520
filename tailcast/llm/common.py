"""Helpers shared by the operators: tables, shared-folder stages, checked broadcasts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000       # most rows of a side that may be broadcast; its row width is fixed by the caller


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a local master may fall back to a
    temporary folder; a cluster without the setting is an error, as each executor
    would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tailcast-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost
    executor costs single tasks, and whatever reads it twice sees the same rows."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if it has at most ``rows`` rows (the count reads
    Parquet footers); a larger one is joined by shuffling, where AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= rows else df


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
