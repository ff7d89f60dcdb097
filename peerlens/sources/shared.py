"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; below the warehouse, which is shared too, where there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends; else they stay until the driver's garbage collector finds their plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For queries that are run once: what they have shuffled leaves the disk when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written and read again: what follows sees the same rows in the same files, whoever is lost meanwhile."""
    path = shared_path(df.sparkSession, label)
    with passing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where fewer tasks than these would read them (a file of one row group is one task's); what is
    read by many tasks stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt by cols over all of spark.sql.shuffle.partitions, for groups made of short rows: an exchange that Spark places
    itself is read by as few tasks as its compressed size asks for, and a row may be 40 times larger in a task's memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at, files = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def made(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.mkdirs(at)


def removed(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.delete(at, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Whether it could be renamed: not if new is there."""
    at, files = _hadoop(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    return not files.exists(to) and files.rename(at, to)
