"""Corpus support: how often a pair occurs together, and with which words.

Counts are made with plain grouped aggregates, so copies of a frequent pair merge on the map side and
no task ever holds all rows of one pair.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import scan
from pairlens.functions import text as tx
from pairlens.operators.mentions import MAX_TOKENS_AWAY, MIN_TOKENS_AWAY, as_key, exploded, mentions_of

# Fixed value.
PMI_THRESHOLD = 0.65

PAIR = ["e1_type", "e2_type", "e1", "e2"]


def near_pairs(text_col: str) -> Column:
    """Ordered pairs of tagged entities 1..6 positions apart, once per sentence in ``text_col``, with the phrase between their last tags.

    A tagged entity counts as one token; the phrase is null unless it has 1..6 tokens.
    """
    return scan.near_column(F.col(text_col), MIN_TOKENS_AWAY, MAX_TOKENS_AWAY)


def proximity_hits(sentences: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per (sentence, ordered near pair) with the phrase between their last tags."""
    rows = exploded(sentences.filter(tx.has_spans(F.col(text_col))), near_pairs(text_col), "p")
    return rows.select(*sentences.columns, *[f"p.{c}" for c in PAIR], "p.phrase")


def flag_near_mentions(sentences: DataFrame, window: int, types=None, text_col: str = "text") -> DataFrame:
    """Mentions with ``near``: the pair is a proximity hit of the same sentence.

    Only sentences that hold a mention pay for the proximity test.
    """
    rows = sentences.filter(tx.has_spans(F.col(text_col)))
    rows = exploded(rows, mentions_of(text_col, window, as_key(types), with_near=True))
    return rows.select(*sentences.columns, *[f"m.{c}" for c in ("e1", "e1_type", "e2", "e2_type", "bef", "bet", "aft", "gap", "near")])


def corpus_evidence(sentences: DataFrame, window: int, types=None, text_col: str = "text") -> DataFrame:
    """Everything the evaluation counts in a corpus, from one scan and one aggregate.

    Rows of ``kind`` mention are the distinct mentions with ``n`` and ``n_near``; rows of ``kind`` hit are (pair, phrase)
    with ``n`` hits, the empty phrase being all hits of the pair: a hit counts under it, and once more under its phrase if it
    has one.  Sentences without two entities, null or empty
    ones among them, give nothing.
    """
    texts = sentences.filter(tx.has_spans(F.col(text_col))).select(text_col)
    rows = texts.mapInArrow(scan.evidence_rows(window, MIN_TOKENS_AWAY, MAX_TOKENS_AWAY, as_key(types)), f"x {scan.ddl(scan.EVIDENCE)}")
    rows = rows.select(F.explode("x").alias("x")).select("x.*")
    counted = rows.groupBy("kind", *PAIR, "bef", "bet", "aft", "phrase").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"))
    # Contexts are summed as texts; no token is empty or holds a blank.
    tokens = {c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")) for c in ("bef", "bet", "aft")}
    return counted.withColumns(tokens)


def superset_in(evidence: DataFrame) -> DataFrame:
    """The distinct mentions of counted evidence, as ``superset_of`` gives them."""
    return evidence.filter("kind = 'mention'").select(*PAIR, "bef", "bet", "aft", "n", "n_near")


def phrases_in(evidence: DataFrame) -> DataFrame:
    """The phrase counts of counted evidence, as ``phrase_counts`` gives them."""
    return evidence.filter("kind = 'hit'").select(*PAIR, "phrase", F.col("n").alias("hits"))


def superset_of(mentions: DataFrame) -> DataFrame:
    """Distinct mentions with ``n`` occurrences, ``n_near`` of them in a proximity hit."""
    return mentions.groupBy(*PAIR, "bef", "bet", "aft").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("near").alias("n_near")
    )


def phrase_counts(hits: DataFrame) -> DataFrame:
    """Hits per (pair, phrase); the row with an empty phrase is the total of the pair.

    Both levels come from one aggregate, so the corpus is read once and partial sums do the merging.
    """
    keys = F.explode(F.array_compact(F.array(F.lit(""), "phrase")))
    return hits.select(*PAIR, keys.alias("phrase")).groupBy(*PAIR, "phrase").agg(F.count(F.lit(1)).alias("hits"))


def exact_phrase_verdicts(triples: DataFrame, counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Verdict ``supported`` for each distinct (rel_type, e1, e2, bet); other columns of ``triples`` stay.

    The share is over all hits of the pair; below the threshold a BET that equals a relational word
    still passes, but only when the pair has hits.  A triple whose relation the catalogue doesn't have is not supported.
    """
    kinds = F.broadcast(catalogue.select("rel_type", "e1_type", "e2_type", "unigrams", "bigrams"))
    word = F.trim(F.col("bet"))
    asked = triples.join(kinds, "rel_type", "left").withColumns(
        {
            "own_phrase": F.array_join(tx.tokenize(F.col("bet")), " "),
            "listed": F.array_contains("unigrams", word) | F.array_contains("bigrams", word),
        }
    ).drop("unigrams", "bigrams")
    # An empty own phrase can match no phrase, so only the total is asked for.
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.lit(""), "own_phrase"))).alias("phrase"))
    joined = asked.join(counts, [*PAIR, "phrase"], "left")
    is_total = F.col("phrase") == ""
    hits = F.coalesce("hits", F.lit(0))
    merged = joined.groupBy(*triples.columns, "listed").agg(
        F.sum(F.when(~is_total, hits).otherwise(0)).alias("phrase_hits"),
        F.sum(F.when(is_total, hits).otherwise(0)).alias("pair_hits"),
    )
    share = F.col("phrase_hits") / F.col("pair_hits")
    return merged.select(
        *triples.columns,
        "phrase_hits",
        "pair_hits",
        F.when(F.col("pair_hits") > 0, (share >= PMI_THRESHOLD) | F.col("listed")).otherwise(False).alias("supported"),
    )


def has_relational_word(bet: Column, unigrams: Column, bigrams: Column) -> Column:
    """A relation unigram, or a bigram of the re-tokenised text, occurs in BET."""
    return F.arrays_overlap(bet, unigrams) | F.arrays_overlap(tx.token_bigrams(bet), bigrams)


def keyword_in_context(bef: Column, bet: Column, aft: Column, unigrams: Column, bigrams: Column) -> Column:
    """As above, with unigrams also accepted in BEF and AFT."""
    return has_relational_word(bet, unigrams, bigrams) | F.arrays_overlap(bef, unigrams) | F.arrays_overlap(aft, unigrams)


def with_relations(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Mentions once per relation with their argument types, flagged by that relation's words.

    The catalogue is broadcast; it has twelve rows whatever the corpus.
    """
    joined = mentions.join(F.broadcast(catalogue.drop("bigrams_declared")), ["e1_type", "e2_type"])
    return joined.withColumn(
        "word_in_bet", has_relational_word(F.col("bet"), F.col("unigrams"), F.col("bigrams"))
    ).withColumn(
        "word_in_context",
        F.col("word_in_bet") | F.arrays_overlap("bef", "unigrams") | F.arrays_overlap("aft", "unigrams"),
    ).drop("unigrams", "bigrams")


def pair_support(superset: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per (rel_type, e1, e2): distinct mentions, keyword mentions, and supporting mentions with/without words."""
    flagged = with_relations(superset, catalogue)
    return flagged.groupBy("rel_type", "e1", "e2").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if("word_in_context").alias("keyword_mentions"),
        F.sum("n_near").alias("total"),
        F.sum(F.when(F.col("word_in_bet"), F.col("n_near")).otherwise(0)).alias("with_word"),
    )


def well_supported(total: Column, with_word: Column, threshold: float = PMI_THRESHOLD) -> Column:
    """Share of supporting mentions with a relational word; false without any mention."""
    return F.coalesce(with_word / F.nullif(total, F.lit(0)) >= threshold, F.lit(False))
