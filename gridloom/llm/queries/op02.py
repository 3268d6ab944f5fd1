"""Query of the secret scans; tested against a plain scan of small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import secrets
from gridloom.llm.queries.inputs import documents


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))
