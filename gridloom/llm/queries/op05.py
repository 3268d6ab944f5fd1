"""Query of best-fit packing; tested against a plain search over all bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import packing
from gridloom.llm.queries.inputs import documents


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))
