"""Judge a system's facts against a knowledge base and a tagged corpus, all relations in one plan.

Regions: ``b`` facts found in the knowledge base; ``a`` facts outside it that the corpus supports;
``c`` knowledge-base pairs stated in the corpus but not found by the system; ``d`` supported corpus
pairs outside the knowledge base that the system missed.

Facts are merged into distinct (relation, pair, BET) triples before any join, so a pair that holds a
large share of all facts is one row per map task when it is shuffled.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators import store as st
from pairlens.operators import support as sp
from pairlens.operators.mentions import EVALUATION_WINDOW
from pairlens.session import materialise
from pairlens.sources.catalogue import KEEP_ORDER_ON_PASSIVE

PAIR_KEY = ["rel_type", "e1", "e2"]
TRIPLE_KEY = [*PAIR_KEY, "bet"]
FACT_KEY = [*PAIR_KEY, "score", "bef", "bet", "aft", "sentence"]


def orient_on_passive(facts: DataFrame) -> DataFrame:
    """Exchange the arguments of passive facts, except for the relations that keep their order."""
    swap = F.col("passive") & ~F.col("rel_type").isin(KEEP_ORDER_ON_PASSIVE)
    swap = F.coalesce(swap, F.lit(False))
    return facts.withColumns(
        {
            "e1": F.when(swap, F.col("e2")).otherwise(F.col("e1")),
            "e2": F.when(swap, F.col("e1")).otherwise(F.col("e2")),
        }
    )


def score_threshold(facts: DataFrame, threshold: float) -> DataFrame:
    return facts.filter(F.col("score") >= threshold)


def distinct_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*FACT_KEY).agg(F.max("passive").alias("passive"))


def distinct_kb(kb: DataFrame) -> DataFrame:
    return kb.select(*PAIR_KEY).distinct()


def in_kb(rows: DataFrame, kb: DataFrame) -> DataFrame:
    return rows.join(distinct_kb(kb), PAIR_KEY, "left_semi")


def not_in_kb(rows: DataFrame, kb: DataFrame) -> DataFrame:
    return rows.join(distinct_kb(kb), PAIR_KEY, "left_anti")


def triples_of(facts: DataFrame) -> DataFrame:
    """Distinct (relation, pair, BET) with the number of facts ``n_facts``; a verdict is made once for each."""
    return facts.groupBy(*TRIPLE_KEY).agg(F.count(F.lit(1)).alias("n_facts"))


def split_by_kb(pairs: DataFrame, kb: DataFrame) -> DataFrame:
    """Per pair of the corpus or the knowledge base: is it ``known``, and what the corpus says about it."""
    zero = F.lit(0).cast("bigint")
    counts = ["keyword_mentions", "total", "with_word"]
    stated = pairs.select(*PAIR_KEY, F.lit(False).alias("known"), *counts)
    known = kb.select(*PAIR_KEY, F.lit(True).alias("known"), *[zero.alias(c) for c in counts])
    return stated.unionByName(known).groupBy(*PAIR_KEY).agg(F.max("known").alias("known"), *[F.sum(c).alias(c) for c in counts])


def pair_ledger(verdicts: DataFrame, pairs: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """Everything known about a pair in one row, from facts, corpus and knowledge base.

    A union and one aggregate instead of a chain of joins: hot pairs merge on the map side and each
    input is read once.  Without ``kb``, ``pairs`` are split by it already (``split_by_kb``).
    """
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    sides = [
        verdicts.select(
            *PAIR_KEY, "n_facts", F.when(F.col("supported"), F.col("n_facts")).otherwise(0).alias("n_supported"),
            no.alias("known"), zero.alias("keyword_mentions"), zero.alias("total"), zero.alias("with_word"),
        ),
        pairs.select(
            *PAIR_KEY, zero.alias("n_facts"), zero.alias("n_supported"), no.alias("known") if kb is not None else "known",
            "keyword_mentions", "total", "with_word",
        ),
    ]
    if kb is not None:
        sides.append(kb.select(
            *PAIR_KEY, zero.alias("n_facts"), zero.alias("n_supported"), F.lit(True).alias("known"),
            zero.alias("keyword_mentions"), zero.alias("total"), zero.alias("with_word"),
        ))
    sums = ["n_facts", "n_supported", "keyword_mentions", "total", "with_word"]
    merged = reduce(DataFrame.unionByName, sides).groupBy(*PAIR_KEY).agg(
        F.max("known").alias("known"), *[F.sum(c).alias(c) for c in sums]
    )
    known = F.col("known")
    return merged.withColumns(
        {
            "a": F.when(~known, F.col("n_supported")).otherwise(0),
            "b": F.when(known, F.col("n_facts")).otherwise(0),
        }
    )


def missed_pairs(ledger: DataFrame, subtract: bool = True) -> DataFrame:
    """Pairs the corpus states by a relational word, with ``region`` c or d.

    ``subtract=False`` keeps pairs the system did find.
    """
    return with_missed(ledger, subtract).filter(F.col("region").isNotNull()).select(
        *PAIR_KEY, "region", "keyword_mentions"
    )


def with_missed(ledger: DataFrame, subtract: bool = True) -> DataFrame:
    stated = F.col("keyword_mentions") > 0
    supported = sp.well_supported(F.col("total"), F.col("with_word"))
    open_b, open_a = (F.col("b") == 0, F.col("a") == 0) if subtract else (F.lit(True), F.lit(True))
    region = F.when(F.col("known") & stated & open_b, "c").when(~F.col("known") & stated & supported & open_a, "d")
    return ledger.withColumn("region", region)


def region_sizes(catalogue: DataFrame, ledger: DataFrame, subtract: bool = True) -> DataFrame:
    """One row per relation of the catalogue, and of any other that has facts, with the size of every region.

    s, a, b and not_found count facts; c and d count distinct mentions; the rest count pairs.
    """

    def where(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(0))

    in_c, in_d = F.col("region") == "c", F.col("region") == "d"
    sizes = with_missed(ledger, subtract).groupBy("rel_type").agg(
        F.sum("n_facts").alias("s"),
        F.sum("a").alias("a"),
        F.sum("b").alias("b"),
        F.sum(F.col("n_facts") - F.col("a") - F.col("b")).alias("not_found"),
        where(in_c, F.col("keyword_mentions")).alias("c"),
        where(in_d, F.col("keyword_mentions")).alias("d"),
        F.count_if(in_c).alias("c_pairs"),
        F.count_if(in_d).alias("d_pairs"),
        F.count_if((F.col("a") > 0) | (F.col("b") > 0) | F.col("region").isNotNull()).alias("g_pairs"),
    )
    names = [c for c in sizes.columns if c != "rel_type"]
    # Twelve relations on the left: the join adds those without any row.
    declared = catalogue.select("rel_type", F.lit(True).alias("declared"))
    joined = declared.join(sizes, "rel_type", "full").filter("declared OR s > 0")
    return joined.select("rel_type", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def ground_truth(ledger: DataFrame, subtract: bool = True) -> DataFrame:
    """Distinct pairs of a, b, c and d."""
    rows = with_missed(ledger, subtract)
    return rows.filter((F.col("a") > 0) | (F.col("b") > 0) | F.col("region").isNotNull()).select(*PAIR_KEY)


def fact_regions(facts: DataFrame, verdicts: DataFrame, kb: DataFrame) -> DataFrame:
    """Each fact with its region a, b or not_found."""
    known = distinct_kb(kb).withColumn("known", F.lit(True))
    judged = verdicts.join(known, PAIR_KEY, "left")
    region = F.when(F.col("known"), "b").when(F.col("supported"), "a").otherwise("not_found")
    return facts.join(judged.select(*TRIPLE_KEY, region.alias("region")), TRIPLE_KEY)


def evaluation_metrics(sizes: DataFrame) -> DataFrame:
    """Precision, recall and F1; all zero when there are no facts or none is right."""
    right = F.col("a") + F.col("b")
    scored = (F.col("s") > 0) & (right > 0)
    precision = F.when(scored, right / F.col("s")).otherwise(0.0)
    recall = F.when(scored, right / (right + F.col("c_pairs") + F.col("d_pairs"))).otherwise(0.0)
    out = sizes.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(
        F.col("precision") + F.col("recall") > 0,
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(0.0)
    return out.withColumn("f1", f1)


def positives(facts_with_region: DataFrame) -> DataFrame:
    """a and b, best score first."""
    return rank_facts(facts_with_region.filter(F.col("region").isin("a", "b")))


def negatives(facts_with_region: DataFrame) -> DataFrame:
    """Facts in neither the knowledge base nor supported by the corpus, best score first."""
    return rank_facts(facts_with_region.filter(F.col("region") == "not_found"))


def rank_facts(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("score"), "rel_type", "e1", "e2", "sentence")


@dataclass
class CorpusStatistics:
    """What one pass over the corpora yields; everything after it works on these aggregates."""

    superset: DataFrame  # distinct mentions of the corpus with n, n_near
    pairs: DataFrame  # per (rel_type, e1, e2) keyword and support counts
    phrases: DataFrame  # hits per (pair, phrase) of the support corpus
    store: st.Store | None = None  # where what follows from the corpus is kept
    params: dict = field(default_factory=dict)  # what it depends on


def corpus_statistics(
    corpus: DataFrame, catalogue: DataFrame, types, support_corpus: DataFrame | None = None, text_col: str = "text",
    store: st.Store | None = None, window: int = EVALUATION_WINDOW,
) -> CorpusStatistics:
    """Aggregates of the corpus; the support corpus defaults to the same one.

    Each corpus is read and tokenised once: its counted evidence is written, and both kinds are read from there.
    With a ``store`` a later run over the same files reads it instead of the corpus.
    """

    def counted(part: DataFrame) -> tuple[DataFrame, dict]:
        def build() -> DataFrame:
            return sp.corpus_evidence(part.select(text_col), window, types, text_col)

        if store is None:
            return materialise(build(), "evidence"), {}
        params = store.key(part, window=window, types=sorted(set(types)) if types else None)
        return st.materialise_superset(part.sparkSession, store.base, params, build), params

    evidence, params = counted(corpus)
    superset = sp.superset_in(evidence)
    pairs = sp.pair_support(superset, catalogue)
    if support_corpus is not None:
        evidence, backing = counted(support_corpus)
        support = sp.pair_support(sp.superset_in(evidence), catalogue).select(*PAIR_KEY, "total", "with_word")
        pairs = pairs.drop("total", "with_word").join(support, PAIR_KEY, "left")
        params = {**params, "support": backing}
    if store is not None:
        # At most twelve relations with their words.
        params = {**params, "words": sorted(str(r) for r in catalogue.collect())}
    return CorpusStatistics(superset, pairs, sp.phrases_in(evidence), store, params)


def corpus_split(stats: CorpusStatistics, kb: DataFrame) -> DataFrame:
    """The pairs of the corpus and the knowledge base, stored where the statistics are."""
    if stats.store is None:
        return split_by_kb(stats.pairs, kb)
    return st.materialise_kb_split(
        kb.sparkSession, stats.store.base, {**stats.params, "kb": stats.store.key(kb)}, lambda: split_by_kb(stats.pairs, kb)
    ).select(*PAIR_KEY, "known", "keyword_mentions", "total", "with_word")


def high_pmi(stats: CorpusStatistics, kb: DataFrame, catalogue: DataFrame, threshold: float = sp.PMI_THRESHOLD) -> DataFrame:
    """Mentions with a relational word whose pair is outside the knowledge base and supported by the corpus."""

    def build() -> DataFrame:
        good = corpus_split(stats, kb).filter(~F.col("known") & sp.well_supported(F.col("total"), F.col("with_word"), threshold))
        stated = sp.with_relations(stats.superset, catalogue).filter("word_in_context")
        return stated.join(good.select(*PAIR_KEY), PAIR_KEY, "left_semi")

    if stats.store is None:
        return build()
    params = {**stats.params, "kb": stats.store.key(kb), "threshold": threshold}
    return st.materialise_high_pmi(kb.sparkSession, stats.store.base, params, build)


@dataclass
class Evaluation:
    facts: DataFrame
    kb: DataFrame
    verdicts: DataFrame
    ledger: DataFrame
    sizes: DataFrame
    metrics: DataFrame

    def fact_regions(self) -> DataFrame:
        return fact_regions(self.facts, self.verdicts, self.kb)


def evaluate(
    facts: DataFrame, kb: DataFrame, stats: CorpusStatistics, catalogue: DataFrame, subtract: bool = True, stored: bool = False
) -> Evaluation:
    """Evaluate scored system facts, or classified facts whose score is null.

    With ``stored`` the distinct facts are written once; else whoever asks for their regions makes them twice, as verdicts need
    fewer of their columns.
    """
    unique = materialise(distinct_facts(facts), "facts") if stored else distinct_facts(facts)
    verdicts = sp.exact_phrase_verdicts(triples_of(unique), stats.phrases, catalogue)
    if stats.store is None:
        ledger = pair_ledger(verdicts, stats.pairs, kb)
    else:
        ledger = pair_ledger(verdicts, corpus_split(stats, kb))
    sizes = region_sizes(catalogue, ledger, subtract)
    return Evaluation(unique, kb, verdicts, ledger, sizes, evaluation_metrics(sizes))
