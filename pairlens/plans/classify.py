"""Index labelled mentions and label new ones by their nearest neighbours."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import minhash as mh
from pairlens.functions.columns import built_once, let
from pairlens.functions.shingles import drop_empty, mention_shingles
from pairlens.functions.tagger import with_lemmas
from pairlens.functions.tagging import tag_tokens
from pairlens.operators import neighbours as nb
from pairlens.operators.mentions import FEATURE_WINDOW, exploded, extract_mentions, known_pair_contexts, tagged_mentions, tagged_sentences
from pairlens.session import materialise, spread

# The default run.
DEFAULT_SIGS, DEFAULT_BANDS, DEFAULT_K = 200, 25, 7
NO_LABEL = "None"

Tagger = Callable[[Column], Column] | None


@built_once
def _features_of(tagger: Tagger) -> Column:
    """Shingles from the columns e1_type, e2_type, bef, bet and aft; the contexts are tagged in one go."""
    n_bef, n_bet = F.size("bef"), F.size("bet")

    def assemble(tagged: Column) -> Column:
        return mention_shingles(
            F.col("e1_type"),
            F.col("e2_type"),
            F.slice(tagged, F.lit(1), n_bef),
            F.slice(tagged, n_bef + 1, n_bet),
            F.slice(tagged, n_bef + n_bet + 1, F.size("aft")),
        )

    return let(tag_tokens(F.concat("bef", "bet", "aft"), tagger), assemble)


def mention_features(mentions: DataFrame, tagger: Tagger = None) -> DataFrame:
    """Adds ``shingles`` to mentions."""
    return mentions.withColumn("shingles", _features_of(tagger))


def tagged_features(rows: DataFrame) -> DataFrame:
    """Adds ``shingles`` to mentions whose contexts are tagged."""
    parts = [F.col(c) for c in ("e1_type", "e2_type", "bef", "bet", "aft")]
    return rows.withColumn("shingles", mention_shingles(*parts))


def training_features(training: DataFrame, tagger: Tagger = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features of labelled (rel_id, rel_type, e1, e2, sentence) rows, and the rows that have none.

    The first occurrence of the pair within the distance limit is used, e1 in front; a row without
    one, or whose names are not tagged in the sentence, goes to the second frame. With ``whole`` the tagger is given
    sentences instead of contexts.
    """
    keyed, made, bad = training_contexts(training, tagger, whole)
    return keyed.join(made, "bag").select("rel_id", "rel_type", "shingles"), bad


def training_contexts(training: DataFrame, tagger: Tagger = None, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled rows (rel_id, rel_type, bag) by the context of their pair, the features (bag, shingles) of each different context, and the
    rows without one; which rows that are is told by ``training_features``."""
    contexts = known_pair_contexts(F.col("sentence"), F.col("e1"), F.col("e2"))
    # The spans come out of a generator, so the tests on types are not moved below it with searches of their own.
    rows = training.select("*", F.explode_outer(F.array(_spans())).alias("spans"))
    rows = rows.select(*training.columns, _type_of("e1").alias("e1_type"), _type_of("e2").alias("e2_type"))
    typed = (F.col("e1_type") != "") & (F.col("e2_type") != "")
    cut, good = contexts, rows.filter(typed)
    if whole:
        good = tagged_sentences(good, tagger, "sentence")
        cut = known_pair_contexts(F.col("sentence"), F.col("e1"), F.col("e2"), tagged=F.col("tagged"))
    good = exploded(good, F.slice(cut, F.lit(1), F.lit(1)))
    good = good.select("rel_id", "rel_type", "e1_type", "e2_type", "m.bef", "m.bet", "m.aft")
    keyed, made = by_context(good, tagger, whole, "training-contexts")
    return keyed, made, rows.filter(~typed | (F.size(contexts) == 0)).select(*training.columns)


#: What the features of a mention depend on.
CONTEXT = ["e1_type", "e2_type", "bef", "bet", "aft"]


def by_context(found: DataFrame, tagger: Tagger, whole: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``bag`` in place of their context, and the features (bag, shingles) of each different context.

    Copies merge by all columns of the context, whose key the bag is, so a plain hash aggregate does it. Lemmas depend on tokens and
    tags alone; where contexts have none yet, they are added to the different ones.
    """
    keyed = materialise(nb.with_bag(found, *CONTEXT), name)
    distinct = spread(keyed.select("bag", *CONTEXT).distinct(), "bag")
    if whole and "lemma" not in keyed.schema["bet"].dataType.elementType.names:
        distinct = distinct.withColumns({c: with_lemmas(F.col(c)) for c in ("bef", "bet", "aft")})
    made = tagged_features(distinct) if whole else mention_features(distinct, tagger)
    return keyed.drop(*CONTEXT), made.select("bag", "shingles")


def _spans() -> Column:
    """Names and types of the tagged spans of a sentence."""
    names, types = (F.regexp_extract_all("sentence", F.lit(r"<([A-Z]+)>([^<]+)</[A-Z]+>"), F.lit(i)) for i in (2, 1))
    return F.struct(names.alias("names"), types.alias("types"))


def _type_of(name: str) -> Column:
    """Type of the first of the ``spans`` with this name; compared as text, so names need no escaping."""
    place = F.array_position("spans.names", F.col(name)).cast("int")
    return F.coalesce(F.get("spans.types", place - 1), F.lit(""))


@dataclass
class LshIndex:
    """``labelled(rel_id, rel_type, sig)``, the last written row of each bag, and ``buckets(band, key, rel_id)``."""

    labelled: DataFrame
    buckets: DataFrame
    n_sigs: int
    n_bands: int

    def write(self, path: str) -> None:
        self.labelled.write.mode("overwrite").parquet(f"{path}/labelled")
        self.buckets.write.mode("overwrite").parquet(f"{path}/buckets")

    @staticmethod
    def read(spark: SparkSession, path: str, n_sigs: int, n_bands: int) -> LshIndex:
        mh.rows_per_band(n_sigs, n_bands)
        return LshIndex(
            spark.read.parquet(f"{path}/labelled"), spark.read.parquet(f"{path}/buckets"), n_sigs, n_bands
        )


def build_lsh_index(features: DataFrame, n_sigs: int = DEFAULT_SIGS, n_bands: int = DEFAULT_BANDS) -> LshIndex:
    """Index (rel_id, rel_type, shingles) rows; signatures are stored once and the buckets read from them."""
    mh.rows_per_band(n_sigs, n_bands)
    signed = materialise(nb.signatures(nb.with_bag(features, "shingles"), n_sigs, ["rel_id", "rel_type", "bag"]), "signed")
    return index_of_bags(signed.drop("sig"), signed.select("bag", "sig").distinct(), n_sigs, n_bands)


def train_index(
    training: DataFrame, tagger: Tagger = None, whole: bool = False, n_sigs: int = DEFAULT_SIGS, n_bands: int = DEFAULT_BANDS
) -> LshIndex:
    """Index of labelled rows as ``training_features`` takes them; each different context is tagged and signed once."""
    keyed, made, _ = training_contexts(training, tagger, whole)
    return index_of_bags(keyed, nb.signatures(made, n_sigs, ["bag"]), n_sigs, n_bands)


def index_of_bags(rows: DataFrame, bags: DataFrame, n_sigs: int, n_bands: int) -> LshIndex:
    """Index of labelled rows (rel_id, rel_type, bag) whose signatures are ``bags`` (bag, sig), a row for each bag."""
    mh.rows_per_band(n_sigs, n_bands)
    labelled = materialise(nb.last_of_bags(rows, materialise(bags, "index-bags")), "labelled")
    buckets = nb.last_writers(nb.band_rows(labelled, n_sigs, n_bands, ["rel_id"]))
    return LshIndex(labelled, buckets, n_sigs, n_bands)


def label_bags(bags: DataFrame, index: LshIndex, k: int) -> DataFrame:
    """Label, votes and candidates of every signed bag that meets a candidate."""
    rows = nb.band_rows(bags, index.n_sigs, index.n_bands, ["bag"])
    scored = nb.scored_candidates(nb.candidates(rows, index.buckets), bags, index.labelled, index.n_sigs)
    return nb.majority(nb.vote_counts(nb.top_k_neighbours(scored, k)))


def join_labels(keyed: DataFrame, bags: DataFrame, index: LshIndex, k: int) -> DataFrame:
    """``rel_type`` and ``votes`` for every row by its ``bag``; rows without a candidate get ``None``."""
    labels = label_bags(materialise(bags, "bags"), index, k)
    return keyed.join(labels, "bag", "left").drop("bag").withColumns(
        {
            "rel_type": F.coalesce("rel_type", F.lit(NO_LABEL)),
            "votes": F.coalesce("votes", F.lit(0)).cast("bigint"),
        }
    )


def classify_features(features: DataFrame, index: LshIndex, k: int = DEFAULT_K) -> DataFrame:
    """Labels rows with ``shingles``.

    Copies of a bag are signed and looked up once, then the label is joined back to all of them.
    """
    bagged = nb.with_bag(features.withColumn("shingles", drop_empty(F.col("shingles"))), "shingles")
    return join_labels(bagged.drop("shingles"), nb.distinct_bags(bagged, index.n_sigs), index, k)


def classify_mentions(
    sentences: DataFrame, index: LshIndex, k: int = DEFAULT_K, tagger: Tagger = None, text_col: str = "text", whole: bool = False
) -> DataFrame:
    """Tagged sentences -> (e1, e2, sentence, rel_type, votes), one row per mention."""
    keyed, features = context_features(sentences, tagger, text_col, whole)
    return join_labels(keyed, nb.signatures(features, index.n_sigs, ["bag"]), index, k)


def context_features(
    sentences: DataFrame, tagger: Tagger = None, text_col: str = "text", whole: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Mentions (bag, e1, e2, sentence) and the features (bag, shingles) of their contexts.

    Features depend on the types and contexts alone, so they are made once per distinct context. With ``whole`` the tagger
    is given whole sentences, and a context is one with its tags.
    """
    if whole:
        found = tagged_mentions(sentences.select(text_col), tagger, FEATURE_WINDOW, text_col=text_col, lemmas=False)
    else:
        found = extract_mentions(sentences.select(text_col), FEATURE_WINDOW, text_col=text_col)
    found = found.withColumnRenamed(text_col, "sentence").select("e1", "e2", "sentence", *CONTEXT)
    keyed, made = by_context(found, tagger, whole, "mentions")
    return keyed.select("bag", "e1", "e2", "sentence"), made
