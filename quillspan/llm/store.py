"""Where intermediate results go: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quillspan.sources.shared import ensure_shared_dir


def few(df: DataFrame) -> DataFrame:
    """``df`` from two tasks for each core at most: Hadoop starts a process for each file that it writes to a local disk, and one that starts holds all of the executor's memory for a moment."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so that a lost executor costs no more than its tasks."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but read from files of known size: the planner multiplies the sizes of joined checkpoints, in loops without end."""
    spark = df.sparkSession
    path = f"{ensure_shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes the files of tables that ``written`` made, once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forgotten(df: DataFrame) -> None:
    """Lets Spark's cleaner take away the files of shuffles that nothing refers to: it learns of them when the driver collects garbage, which a large heap puts off."""
    df.sparkSession._jvm.System.gc()
