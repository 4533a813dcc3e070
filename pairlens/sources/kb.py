"""Knowledge-base files -> (rel_type, e1, e2) pairs in the argument order of the relation.

The line parsers work on a frame of lines, so they serve files and any other source alike.  Each gives
the good pairs; ``bad_lines`` gives the lines with a wrong number of fields.
"""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources import catalogue as cat

# Fixed value.
RESOURCE_PREFIX = "<http://dbpedia.org/resource/"
FIELDS = {"freebase": ("\t", 3), "yago": ("\t", 3), "manual": ("\t", 2), "dbpedia": (">", 4)}
COMMENTED = ("freebase", "manual")


def normalise_subject(name: Column) -> Column:
    """``_`` to space, parenthesised qualifiers dropped, trimmed."""
    return F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\([^)]+\)", ""))


def objects_of(name: Column) -> Column:
    """Values of a multi-valued object, separated by ``,_``."""
    return F.transform(F.split(name, ",_"), lambda part: F.trim(F.replace(part, F.lit("_"), F.lit(" "))))


def _after_first_slash(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("/")), F.get(F.split(name, "/"), F.lit(1))).otherwise(name)


def _fields(lines: DataFrame, family: str) -> DataFrame:
    sep, _ = FIELDS[family]
    rows = lines.filter(~F.col("value").startswith("#")) if family in COMMENTED else lines
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    return rows.select(*[c for c in lines.columns if c != "value"], "value", F.split(trimmed, sep).alias("f"))


def good_lines(lines: DataFrame, family: str) -> DataFrame:
    return _fields(lines, family).filter(F.size("f") == FIELDS[family][1])


def bad_lines(lines: DataFrame, family: str) -> DataFrame:
    """Lines that do not have the number of fields of their format."""
    return _fields(lines, family).filter(F.size("f") != FIELDS[family][1]).select("value")


def parse_ntriples(lines: DataFrame) -> DataFrame:
    def bare(i: int) -> Column:
        return F.replace(F.get("f", F.lit(i)), F.lit(RESOURCE_PREFIX), F.lit(""))

    keep = [c for c in lines.columns if c != "value"]
    rows = good_lines(lines, "dbpedia").select(
        *keep, normalise_subject(bare(0)).alias("e1"), F.explode(objects_of(bare(2))).alias("e2")
    )
    return rows


def parse_yago(lines: DataFrame) -> DataFrame:
    def bare(i: int) -> Column:
        return F.translate(_after_first_slash(F.get("f", F.lit(i))), "<>", "")

    keep = [c for c in lines.columns if c != "value"]
    objects = objects_of(F.replace(F.trim(bare(2)), F.lit("."), F.lit("")))
    return good_lines(lines, "yago").select(*keep, normalise_subject(bare(0)).alias("e1"), F.explode(objects).alias("e2"))


def parse_freebase(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c != "value"]
    return good_lines(lines, "freebase").select(
        *keep, F.trim(F.get("f", F.lit(0))).alias("e1"), F.trim(F.get("f", F.lit(2))).alias("e2")
    )


def parse_manual(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c != "value"]
    return good_lines(lines, "manual").select(
        *keep, F.trim(F.get("f", F.lit(0))).alias("e1"), F.trim(F.get("f", F.lit(1))).alias("e2")
    )


PARSERS = {"dbpedia": parse_ntriples, "yago": parse_yago, "freebase": parse_freebase, "manual": parse_manual}


def orient(pairs: DataFrame, swapped: Column) -> DataFrame:
    """Exchange subject and object where ``swapped`` holds."""
    return pairs.withColumns(
        {"e1": F.when(swapped, F.col("e2")).otherwise(F.col("e1")), "e2": F.when(swapped, F.col("e1")).otherwise(F.col("e2"))}
    )


def both_directions(pairs: DataFrame, symmetric: Column) -> DataFrame:
    """Adds the inverse of every pair of a symmetric relation, in one pass over the rows."""
    ways = F.when(symmetric, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    doubled = pairs.withColumn("turned", F.explode(ways))
    return orient(doubled, F.col("turned")).drop("turned")


def parse_family(lines: DataFrame, family: str, rel_type: str, file_name: str = "") -> DataFrame:
    """(rel_type, source, e1, e2) of one file for one relation, oriented."""
    pairs = PARSERS[family](lines).withColumn("rel_type", F.lit(rel_type)).withColumn("source", F.lit(family))
    if family == "freebase" and rel_type in cat.SYMMETRIC_RELATIONS:
        pairs = both_directions(pairs, F.lit(True))
    elif cat.is_swapped(family, file_name, rel_type):
        pairs = orient(pairs, F.lit(True))
    return pairs.select("rel_type", "source", "e1", "e2")


def union_kb(parts: Iterable[DataFrame]) -> DataFrame:
    """All sources in one set of pairs."""
    return reduce(DataFrame.unionByName, parts).select("rel_type", "e1", "e2").distinct()


def load_kb(spark: SparkSession, base_dir: str, rel_types: Iterable[str]) -> DataFrame:
    """Every file of the given relations as one distinct (rel_type, e1, e2) frame; each file is read once per relation."""
    parts = []
    for rel_type in cat.check_relations(rel_types):
        for family, names in cat.KB_FILES[rel_type].items():
            for name in names:
                lines = spark.read.text(f"{base_dir}/{name}")
                parts.append(parse_family(lines, family, rel_type, name))
    return union_kb(parts)


def kb_multimap(kb: DataFrame) -> DataFrame:
    """e1 -> set of e2, for export; joins use the pairs themselves."""
    return kb.groupBy("rel_type", "e1").agg(F.sort_array(F.collect_set("e2")).alias("objects"))
