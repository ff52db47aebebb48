"""Folders for tables and files that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only if that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
    spark.conf.set("spark.checkpoint.dir", LOCAL_FALLBACK)
    return LOCAL_FALLBACK


def _folder(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; the folder goes when the session's JVM ends, if nothing removes it before."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    system, jvm_path = _folder(spark, path)
    system.deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all that is in it."""
    system, jvm_path = _folder(spark, path)
    system.delete(jvm_path, True)
