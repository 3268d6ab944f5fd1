"""Reading texts, the input gate and normalisation, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units that plain input may not hold: C0 but for tab and line ends, DEL and C1, bidi format controls.
REJECTED = "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x9F\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
BIDI_FORMAT = "[\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
UNSAFE_IN_URI = "[\\x00-\\x1F\\x7F-\\x9F]"
MODES = ("normal", "pre-wrap")


def read_documents(spark: SparkSession, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of a Parquet table; only these columns are read."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def is_rejected(text: Column) -> Column:
    return text.rlike(REJECTED)


def has_bidi_controls(text: Column) -> Column:
    return text.rlike(BIDI_FORMAT)


def has_unsafe_controls(text: Column) -> Column:
    return text.rlike(UNSAFE_IN_URI)


def sanitize_plain(text: Column) -> Column:
    """Deletes rejected units; what follows an escape stays."""
    return F.regexp_replace(text, REJECTED, "")


def assert_plain(text: Column) -> Column:
    """The text, or an error that names the first rejected unit."""
    unit = F.hex(F.encode(F.regexp_extract(text, REJECTED, 0), "UTF-16BE"))
    return F.when(is_rejected(text), F.raise_error(F.concat(F.lit("rejected unit U+"), unit)).cast("string")).otherwise(text)


def quarantine(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows)."""
    bad = F.coalesce(is_rejected(F.col(text)), F.lit(False))
    return docs.filter(~bad), docs.filter(bad)


def normalise_column(text: Column, white_space: str = "normal") -> Column:
    check_mode(white_space)
    if white_space == "pre-wrap":
        return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[\r\f]", "\n")
    collapsed = F.regexp_replace(text, "[ \t\n\r\f]+", " ")
    return F.regexp_replace(collapsed, "^ | $", "")


def check_mode(white_space: str) -> None:
    if white_space not in MODES:
        raise ValueError(f"white space must be one of {MODES}")


def normalise(text: str, white_space: str = "normal") -> str:
    """The same for one string."""
    check_mode(white_space)
    if white_space == "pre-wrap":
        return re.sub("[\r\f]", "\n", text.replace("\r\n", "\n"))
    return re.sub("[ \t\n\r\f]+", " ", text).strip(" ")
