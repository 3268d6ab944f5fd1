"""A training-corpus pipeline over ``documents``: each stage works on what the one before it has kept.

Stages are written as Parquet and read back between each other, so a stage is computed once and a
lost executor costs no more than its own tasks.  Documents that the rules or the classifier reject
go, one document of each near-duplicate group stays, secrets are masked in the texts, and the last
stage packs the texts into bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import dedup, packing, pulearn, quality, secrets, storage
from gridloom.llm.queries.op10 import THRESHOLD, fold


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; labels of the held-out fold are not learnt."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = pulearn.fit(docs, labels, fold() != 0)
    return pulearn.score(docs, scorer, keep=tuple(docs.columns)).filter(F.col("score") >= THRESHOLD).drop("score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return dedup.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact_documents(docs, secrets.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts, with their masked texts and their bins."""
    return packing.with_texts(packing.pack_documents(docs), docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
