"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only on one machine where none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="veilgraph-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veilgraph/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and fixes row identities."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(df: DataFrame, label: str) -> DataFrame:
    """materialize for tables that grow with the documents, one of many steps of a job.

    Compressed files are a small part of their rows, so a size taken from files would have the driver collect
    and broadcast such a table: its joins are merged. What planning the step left on the driver's heap is freed,
    which else grows to its limit in a job of many plans; shuffle files that nothing refers to go with it.
    """
    out = materialize(df, label)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out.hint("merge")


def release(spark: SparkSession) -> None:
    """Delete every intermediate table that was left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veilgraph")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
