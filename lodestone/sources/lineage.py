"""Cutting lineage between iterations, and the folder for it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or a temporary one where a single machine runs all."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder, so that losing an executor costs no more than this step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
