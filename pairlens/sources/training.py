"""Training sentences and stored features."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.shingles import drop_empty
from pairlens.sources.catalogue import KEEP_ORDER_ON_PASSIVE
from pairlens.sources.corpus import is_content
from pairlens.sources.records import _flag, field, read_records


def _training_rows(lines: DataFrame) -> DataFrame:
    """Lines with content and their fields; ``ok`` tells the good ones.

    Line and fields come out of a generator, so no filter on them is moved below it with a copy of what makes them.
    """
    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    rows = lines.select(F.explode_outer(F.array(F.struct("value", f.alias("f")))).alias("l")).select("l.*").filter(is_content(F.col("value")))
    rel_id = F.get(F.split(F.get("f", F.lit(0)), ":"), F.lit(1)).try_cast("bigint")
    return rows.select(
        "value", rel_id.alias("rel_id"),
        *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(["rel_type", "e1", "e2", "sentence"], 1)],
        ((F.size("f") == 5) & rel_id.isNotNull()).alias("ok"),
    )


def parse_training(lines: DataFrame) -> DataFrame:
    """``id:N``, relation, e1, e2, sentence lines -> (rel_id, rel_type, e1, e2, sentence)."""
    return _training_rows(lines).filter("ok").drop("value", "ok")


def bad_training(lines: DataFrame) -> DataFrame:
    """Lines with content that are no training sentence: another number of fields, or an id that is no number."""
    return _training_rows(lines).filter("NOT ok").select("value")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return parse_training(spark.read.text(path))


def _feature_rows(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    rel_id = F.get("f", F.lit(0)).try_cast("bigint")
    return lines.select("value", f.alias("f")).select(
        "value", rel_id.alias("rel_id"), F.get("f", F.lit(1)).alias("rel_type"),
        drop_empty(F.split(F.trim(F.get("f", F.lit(2))), " ")).alias("shingles"),
        F.coalesce((F.size("f") == 3) & rel_id.isNotNull(), F.lit(False)).alias("ok"),
    )


def parse_features(lines: DataFrame) -> DataFrame:
    """``rel_id``, relation, space-separated shingles -> (rel_id, rel_type, shingles); empties dropped."""
    return _feature_rows(lines).filter("ok").drop("value", "ok")


def bad_features(lines: DataFrame) -> DataFrame:
    """Lines that are no stored features; a null line is one of them."""
    return _feature_rows(lines).filter("NOT ok").select("value")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Text features; stored Parquet features are read with ``spark.read.parquet``."""
    return parse_features(spark.read.text(path))


def _evaluated_rows(records: DataFrame) -> DataFrame:
    record = F.col("value")
    names = F.split(field(record, "instance"), "\t")
    return records.select(
        "value",
        F.get(F.split("file_name", "_"), F.lit(0)).alias("rel_type"),
        F.trim(F.get(names, F.lit(0))).alias("e1"),
        F.trim(F.get(names, F.lit(1))).alias("e2"),
        field(record, "sentence").alias("sentence"),
        _flag(field(record, "passive voice")).alias("passive"),
        F.coalesce(F.size(names) == 3, F.lit(False)).alias("ok"),
    )


def parse_evaluated_facts(records: DataFrame) -> DataFrame:
    """Records of an evaluation -> (rel_type, e1, e2, sentence, passive); the relation is the file-name prefix."""
    return _evaluated_rows(records).filter("ok").drop("value", "ok")


def bad_evaluated_facts(records: DataFrame) -> DataFrame:
    """Records whose instance is not two names and a score."""
    return _evaluated_rows(records).filter("NOT ok").select("value")


def facts_to_training(facts: DataFrame, swap_again: bool = False) -> DataFrame:
    """Positive facts -> (rel_id, rel_type, e1, e2, sentence).

    Passive facts of the relations that keep their order are left out.  The facts are oriented already;
    ``swap_again`` exchanges the arguments of passive facts once more.  The id is a hash of the row: it
    is the same on every run and needs no global numbering.
    """
    kept = facts.filter(~(F.coalesce("passive", F.lit(False)) & F.col("rel_type").isin(KEEP_ORDER_ON_PASSIVE)))
    if swap_again:
        turn = F.coalesce("passive", F.lit(False))
        kept = kept.withColumns(
            {"e1": F.when(turn, F.col("e2")).otherwise(F.col("e1")), "e2": F.when(turn, F.col("e1")).otherwise(F.col("e2"))}
        )
    cols = ["rel_type", "e1", "e2", "sentence"]
    return kept.select(F.xxhash64(*cols).alias("rel_id"), *cols).distinct()


def read_facts_as_training(spark: SparkSession, path: str, swap_again: bool = False) -> DataFrame:
    return facts_to_training(parse_evaluated_facts(read_records(spark, path)), swap_again)
