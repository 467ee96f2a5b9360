"""Session settings and the shared scratch space for iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: UTC clocks and adaptive execution. Many folders are listed by a few tasks per core:
    by default each folder is a task, and handing out tasks is what takes the time then."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    return spark


def spread_small(df: DataFrame) -> DataFrame:
    """Give a scan of fewer tasks than cores one task per core. Large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may go without."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    This cuts the lineage of an iterative job without depending on any executor
    staying alive, and unlike checkpoint() computes the frame a single time.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
