"""Tagged corpora and plain sentence files: one sentence per line."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_tagged_corpus(lines: DataFrame) -> DataFrame:
    """``value`` lines -> (sent_id, text); the id is a hash of the text, stable across runs and partitions."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return lines.select(text.alias("text")).select(F.xxhash64("text").alias("sent_id"), "text")


def read_tagged_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_tagged_corpus(spark.read.text(path))


def is_content(line: Column) -> Column:
    """Neither empty nor a ``#`` comment."""
    return ~line.rlike(r"^(#.*)?$")


def parse_unlabelled_sentences(lines: DataFrame) -> DataFrame:
    return lines.filter(is_content(F.col("value"))).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def read_unlabelled_sentences(spark: SparkSession, path: str) -> DataFrame:
    return parse_unlabelled_sentences(spark.read.text(path))
