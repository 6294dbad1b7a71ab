"""The folder that the driver and all executors share, for checkpoints and tables between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; without one a folder of this machine, if Spark runs on this machine alone, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()
