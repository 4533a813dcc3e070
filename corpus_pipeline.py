"""A training corpus from raw documents: quality rules, line and document near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import line_join, line_rules, pack_nnls, pii_crf, shingle_copies, simhash_ball
from pairlens.session import bounded_batches, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail theirs."""
    return line_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line of the corpus equals or nearly equals."""
    bounded_batches(spark)
    return line_join.drop_repeated_lines(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: first by the ball of SimHash fingerprints, as ``op8_simhash_ball`` links them, then, of
    what the ball cannot reach, by five-word shingles at a similarity of 0.8. Texts are moved once for both, when the rest is left out."""
    bounded_batches(spark)
    return shingle_copies.keep_one(docs, simhash_ball.survivors)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and credentials replaced by their kind."""
    bounded_batches(spark)
    return pii_crf.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    bounded_batches(spark)
    return pack_nnls.pack(docs, keep=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: Edit joins, components, a trained field and a solved packing have no SQL; tests hold each stage's operator against brute force, and the
#: columns, documents and packing of run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
