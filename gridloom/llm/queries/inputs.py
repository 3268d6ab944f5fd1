"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``documents`` (all columns, or some); over the cores where the table has fewer files than there are
    cores, as a file of one row group is one task's work.  A table of many files is read as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(*columns) if columns else docs
    cores = spark.sparkContext.defaultParallelism
    return docs if len(docs.inputFiles()) >= cores else docs.repartition(2 * cores)
