"""Shared scratch space: lineage cuts and tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on local runs."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="commentarium-"))
    return context.getCheckpointDir()


_paths: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _paths.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def path_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _hadoop(spark, path)
    return files.exists(folder)


def clear_scratch(spark: SparkSession) -> None:
    """Drop the tables and files that this process has staged; frames that read them are of no use then."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _paths:
        files, folder = _hadoop(spark, _paths.pop())
        files.delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_columns(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder as Parquet: several passes then read just what they use."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, key: str = "row_id", partitioned: bool = False) -> DataFrame:
    """Write a frame to the shared folder, bucketed by ``key``, and read it back.

    Later joins and groupings on ``key`` find the rows already together and need
    no shuffle; columns not asked for are not read; a lost executor costs a
    re-read of files. Say ``partitioned`` when the frame comes from staged
    tables of the same key: then writing needs no shuffle either.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    laid_out = df if partitioned else df.repartition(buckets, key)
    (
        laid_out.write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", scratch_path(spark, name))
        .saveAsTable(name)
    )
    _tables.append(name)
    return spark.table(name)


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Hash-partition by ``key`` when the input has fewer splits than there are cores.

    A single small file is one split. Large inputs already have many, and then
    this is a no-op: no shuffle is added at scale.
    """
    context = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= context.defaultParallelism:
        return df
    return df.repartition(context.defaultParallelism, key)
