"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes in memory for a byte in files written here, rounded up: ids in order shrink to one byte in 50 or 60.
EXPANSION = 100.0


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new temporary folder where it is unset and all tasks run on this
    machine, as in tests. On a cluster an unset folder is an error: executors could not share it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, without df's lineage; they outlive their executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(spark: SparkSession, schema: str | StructType, *paths: str) -> DataFrame:
    """The rows of Parquet files that were written here. The planner takes the length of a file for its
    size in memory and would send tables of millions of rows to every task by way of the driver, so the
    session is told how much longer they are there; what is small all the same is found as it runs."""
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < EXPANSION:
        spark.conf.set(factor, str(EXPANSION))
    return spark.read.schema(schema).parquet(*paths)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for tables that are kept and read again and again: Parquet files in the shared folder,
    so readers take the columns that they want and the planner knows how large each table is. A
    checkpoint holds whole rows as they lie in memory, uncompressed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return written(df.sparkSession, df.schema, path)


class Scratch:
    """Tables that a piece of work writes on its way, in a folder of its own below the shared one:
    ``with Scratch(spark) as keep: df = keep(df)``. Unlike a checkpoint, which hands what the planner
    had concluded about its columns on to every plan above it (in a loop these conclusions multiply),
    a written table starts afresh. All are deleted at the end, so results must be cut before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n = spark, 0
        self.path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return written(self.spark, df.schema, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
