"""The folder that all executors share, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a fresh local folder only if nothing has set it and all tasks
    run in this process (as in tests).  On a cluster a local folder would not be shared: an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gridloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def table(frame: DataFrame, what: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: it is computed once and outlives executors."""
    spark = frame.sparkSession
    path = fresh(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables that only feed others: deleted together once those are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, frame: DataFrame, what: str) -> DataFrame:
        path = fresh(self.spark, what)
        self.paths.append(path)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            drop(self.spark, path)
        self.paths = []


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
