"""Banded LSH index and nearest-neighbour labelling.

A bucket (band, key) holds one entry, the labelled instance written last, that is the one with the
highest ``rel_id``.  A query therefore meets at most ``n_bands`` candidates, and a bucket shared by a
large part of the data costs one index row and no pairs between its members.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions import minhash as mh
from pairlens.session import materialise


def signatures(features: DataFrame, n_sigs: int, keep: Iterable[str] = ("rel_id", "rel_type")) -> DataFrame:
    hashed = features.select(*keep, mh.shingle_hashes(F.col("shingles")).alias("hashes"))
    return mh.with_signature(hashed, n_sigs).drop("hashes")


def one_per_id(signed: DataFrame) -> DataFrame:
    """One row per ``rel_id``: of rows that repeat an id the largest by label and signature stays, on every run the same."""
    kept = signed.groupBy("rel_id").agg(F.max(F.struct("rel_type", "sig")).alias("row"))
    return kept.select("rel_id", "row.rel_type", "row.sig")


def last_of_bags(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """(rel_id, rel_type, sig): for each bag its row of the highest ``rel_id``, of the rows that ``one_per_id`` keeps.

    Rows of one bag have all bands in common, so none but the last of them can be the entry of a bucket. Only rows that repeat an id
    are brought together with their signatures; their ids are written first, so few of them are joined without a shuffle of all rows.
    """
    several = materialise(repeated_ids(rows).select(F.col("rel_id").alias("own")), "repeated-ids")
    again = F.col("rel_id").eqNullSafe(F.col("own"))
    signed = rows.join(several, again, "left_semi").join(bags, "bag")
    best = signed.groupBy("rel_id").agg(F.max(F.struct("rel_type", "sig", "bag")).alias("row")).select("rel_id", "row.rel_type", "row.bag")
    kept = rows.join(several, again, "left_anti").select("rel_id", "rel_type", "bag").unionByName(best)
    # A maximum of numbers is a hash aggregate, one of structs sorts its rows; so each label's last row is found first.
    per_label = kept.groupBy("bag", "rel_type").agg(F.max("rel_id").alias("rel_id"))
    last = per_label.groupBy("bag").agg(F.max(F.struct("rel_id", "rel_type")).alias("row"))
    return last.join(bags, "bag").select("row.rel_id", "row.rel_type", "sig")


def repeated_ids(features: DataFrame) -> DataFrame:
    """(rel_id, n) of ids that several labelled rows carry; an index keeps one row of each."""
    return features.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def band_rows(signed: DataFrame, n_sigs: int, n_bands: int, keep: Iterable[str]) -> DataFrame:
    exploded = signed.select(*keep, F.explode(mh.band_keys(F.col("sig"), n_sigs, n_bands)).alias("b"))
    return exploded.select(*keep, "b.band", "b.key")


def last_writers(rows: DataFrame, keys: Iterable[str] = ("band", "key")) -> DataFrame:
    """The entry of each bucket; a plain maximum, so crowded buckets shrink before the shuffle."""
    return rows.groupBy(*keys).agg(F.max("rel_id").alias("rel_id"))


def with_bag(rows: DataFrame, *cols: str) -> DataFrame:
    """Adds ``bag``, a 128-bit key of the given columns; copies share it.

    A hash over several arrays runs on from one into the next, so their sizes are hashed too: the borders between the
    columns are part of the key.
    """
    arrays = [c for c in cols if isinstance(rows.schema[c].dataType, T.ArrayType)]
    parts = [*cols, *[F.size(c) for c in arrays]]
    return rows.withColumn(
        "bag", F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))
    )


def distinct_bags(bagged: DataFrame, n_sigs: int) -> DataFrame:
    """One signed row per distinct bag, so copies are signed and looked up once."""
    hashed = bagged.select("bag", mh.shingle_hashes(F.col("shingles")).alias("hashes")).dropDuplicates(["bag"])
    return mh.with_signature(hashed, n_sigs).drop("hashes")


def candidates(query_rows: DataFrame, buckets: DataFrame, query: str = "bag") -> DataFrame:
    """(query, rel_id) sharing at least one bucket, with the number of shared bands."""
    met = query_rows.join(buckets, ["band", "key"])
    return met.groupBy(query, "rel_id").agg(F.count(F.lit(1)).alias("shared_bands"))


def scored_candidates(pairs: DataFrame, queries: DataFrame, labelled: DataFrame, n_sigs: int, query: str = "bag") -> DataFrame:
    """Candidates with their label and estimated similarity."""
    with_label = pairs.join(labelled.select("rel_id", "rel_type", F.col("sig").alias("other_sig")), "rel_id")
    both = with_label.join(queries.select(query, "sig"), query)
    score = mh.signature_similarity(F.col("sig"), F.col("other_sig"), n_sigs)
    return both.select(query, "rel_id", "rel_type", "shared_bands", score.alias("similarity"))


def top_k_neighbours(scored: DataFrame, k: int, query: Iterable[str] = ("bag",)) -> DataFrame:
    """The k best candidates of each query with their ``rank``; at most ``n_bands`` rows are ranked per query."""
    order = Window.partitionBy(*query).orderBy(F.desc("similarity"), "rel_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vote_counts(neighbours: DataFrame, query: Iterable[str] = ("bag",)) -> DataFrame:
    """Labels among the neighbours: one vote per candidate."""
    return neighbours.groupBy(*query, "rel_type").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("similarity").alias("weight")
    )


def majority(votes: DataFrame, query: Iterable[str] = ("bag",)) -> DataFrame:
    """Most frequent label; ties go to the larger summed similarity, then to the smaller label."""
    order = Window.partitionBy(*query).orderBy(F.desc("votes"), F.desc(F.round("weight", 9)), "rel_type")
    best = votes.withColumn("place", F.row_number().over(order)).filter(F.col("place") == 1)
    return best.drop("place", "weight")
