"""Blank-line separated ``key: value`` records: system output, classified output, features of queries.

Files are read with a blank line as the record separator, so Spark splits large files between records.
Every parser returns the good rows; ``bad_records`` returns the text of the others.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.mentions import exploded, known_pair_contexts

RECORD_SEPARATOR = "\n\n"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per row in ``value``; ``file_name`` tells where it came from."""
    raw = spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
    return raw.select("value", F.col("_metadata.file_name").alias("file_name")).filter(F.trim("value") != "")


def field(record: Column, key: str) -> Column:
    """Trimmed rest of the first line that starts with ``key`` and a colon; empty when there is none."""
    return F.trim(F.regexp_extract(record, rf"(?m)^{key}\s*:[ \t]*(.*)$", 1))


def _flag(text: Column) -> Column:
    return F.when(text == "True", True).when(text == "False", False)


def _parse_output(records: DataFrame) -> DataFrame:
    record = F.col("value")
    instance = F.regexp_extract(record, r"(?m)^instance\s*:\s*(.*?)\s*score:", 1)
    names = F.split(instance, "\t")
    return records.withColumns(
        {
            "e1": F.trim(F.get(names, F.lit(0))),
            "e2": F.trim(F.get(names, F.lit(1))),
            "score": F.regexp_extract(record, r"(?m)^instance.*score:\s*([-+0-9.eE]+)", 1).try_cast("double"),
            "bef": field(record, "pattern_bef"),
            "bet": field(record, "pattern_bet"),
            "aft": field(record, "pattern_aft"),
            "sentence": field(record, "sentence"),
            "passive": F.coalesce(_flag(field(record, "passive voice")), F.lit(False)),
            "ok": (F.size(names) == 2),
        }
    ).withColumn("ok", F.col("ok") & F.col("score").isNotNull())


def parse_system_output(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(e1, e2, score, bef, bet, aft, sentence, passive); arguments as written, no threshold applied."""
    parsed = _parse_output(records).filter("ok")
    return parsed.select(*keep, "e1", "e2", "score", "bef", "bet", "aft", "sentence", "passive")


def bad_records(records: DataFrame) -> DataFrame:
    return _parse_output(records).filter(~F.col("ok")).select("value")


def read_system_output(spark: SparkSession, path: str, threshold: float, rel_type: str) -> DataFrame:
    """Facts of one relation with ``score >= threshold``, passive facts turned round."""
    from pairlens.plans.evaluate import orient_on_passive, score_threshold

    facts = parse_system_output(read_records(spark, path)).withColumn("rel_type", F.lit(rel_type))
    return orient_on_passive(score_threshold(facts, threshold))


def _classified_rows(records: DataFrame) -> DataFrame:
    record = F.col("value")
    names = F.split(field(record, "instance"), "\t")
    return records.select(
        "value",
        F.trim(F.get(names, F.lit(0))).alias("e1"),
        F.trim(F.get(names, F.lit(1))).alias("e2"),
        field(record, "sentence").alias("sentence"),
        F.nullif(field(record, "rel_type"), F.lit("")).alias("rel_type"),
        F.coalesce(F.size(names) == 2, F.lit(False)).alias("ok"),
    )


def parse_classified_output(records: DataFrame) -> DataFrame:
    """(e1, e2, sentence, rel_type) of classified records."""
    return _classified_rows(records).filter("ok").drop("value", "ok")


def bad_classified_output(records: DataFrame) -> DataFrame:
    """Records whose instance is not two names."""
    return _classified_rows(records).filter("NOT ok").select("value")


def facts_of_classified(classified: DataFrame) -> DataFrame:
    """One fact per occurrence of the pair in its sentence, within the distance limit in either order.

    BET is what lies between; a reversed occurrence has an empty BET.  There is no score and no passive flag.
    """
    rows = exploded(classified, known_pair_contexts(F.col("sentence"), F.col("e1"), F.col("e2"), forward_only=False))
    return rows.select(
        *classified.columns,
        F.array_join("m.bet", " ").alias("bet"),
        F.lit(None).cast("double").alias("score"),
        F.lit("").alias("bef"),
        F.lit("").alias("aft"),
        F.lit(False).alias("passive"),
    )


def read_classified_output(spark: SparkSession, path: str) -> DataFrame:
    return facts_of_classified(parse_classified_output(read_records(spark, path)))


def _shingle_rows(records: DataFrame) -> DataFrame:
    record = F.col("value")
    bag = F.filter(F.split(field(record, "shingles"), r"\s+"), lambda s: s != "")
    rows = records.select(
        "value", field(record, "e1").alias("e1"), field(record, "e2").alias("e2"),
        field(record, "sentence").alias("sentence"), bag.alias("shingles"),
    )
    return rows.withColumn("ok", F.coalesce((F.col("e1") != "") & (F.col("e2") != ""), F.lit(False)))


def parse_shingle_records(records: DataFrame) -> DataFrame:
    """(e1, e2, sentence, shingles) of stored query features."""
    return _shingle_rows(records).filter("ok").drop("value", "ok")


def bad_shingle_records(records: DataFrame) -> DataFrame:
    """Records without one of the two names."""
    return _shingle_rows(records).filter("NOT ok").select("value")


def read_shingle_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_shingle_records(read_records(spark, path))
