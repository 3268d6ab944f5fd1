"""Query of document fingerprints; tested against a plain version over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import fuzzyhash
from gridloom.llm.queries.inputs import documents


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzyhash.compare_with_edited(documents(spark, sf_dir, "doc_id", "text"))
