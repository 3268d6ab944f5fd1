"""Query of BPE encoding and decoding; tested against the tokenizers library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe
from gridloom.llm.queries.inputs import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.digest(bpe.encode(docs, bpe.Vocabulary.load(path or vocabulary_path())))
