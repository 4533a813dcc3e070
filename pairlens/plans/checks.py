"""Expectations on an evaluation, as rows; an empty region is a warning and never stops a run."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.plans import evaluate as ev


def data_checks(evaluation: ev.Evaluation) -> DataFrame:
    """(check, level, failures): how many relations, pairs or triples break each expectation."""
    sizes = evaluation.sizes.agg(
        F.count_if(F.col("s") != F.col("a") + F.col("b") + F.col("not_found")).alias("facts_in_one_region"),
        F.count_if((F.col("s") > 0) & (F.col("c_pairs") == 0)).alias("region_c_not_empty"),
        F.count_if((F.col("s") > 0) & (F.col("d_pairs") == 0)).alias("region_d_not_empty"),
    )
    pairs = evaluation.ledger.agg(
        F.count_if(F.col("with_word") > F.col("total")).alias("word_hits_within_hits"),
        F.count_if(F.col("a") * F.col("b") != 0).alias("pair_in_a_or_b"),
    )
    triples = evaluation.verdicts.agg(
        F.count_if(F.col("phrase_hits") > F.col("pair_hits")).alias("phrase_hits_within_hits")
    )
    return _as_rows(sizes).unionByName(_as_rows(pairs)).unionByName(_as_rows(triples))


def _as_rows(counts: DataFrame) -> DataFrame:
    """One-row frame of counters -> one row per counter."""
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.lit("warning" if name.endswith("not_empty") else "error").alias("level"),
            F.col(name).alias("failures"),
        )
        for name in counts.columns
    ]
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
