"""One query per job of the engine, over the given tables; each has the same result as its SQL in ``oracle``."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import minhash as mh
from pairlens.functions import phrases as ph
from pairlens.functions import shingles as sh
from pairlens.functions import tagger
from pairlens.functions import tagging as tg
from pairlens.functions import text as tx
from pairlens.functions.columns import let
from pairlens.operators import mentions as mn
from pairlens.operators import neighbours as nb
from pairlens.operators import sinks as sk
from pairlens.operators import store as st
from pairlens.operators import support as sp
from pairlens.plans import bootstrap as bs
from pairlens.plans import checks as ck
from pairlens.plans import classify as cl
from pairlens.plans import evaluate as ev
from pairlens.plans import sweep as sw
from pairlens.session import materialise, shared_folder
from pairlens.sources import catalogue as cat
from pairlens.sources import corpus as co
from pairlens.sources import kb as kbs
from pairlens.sources import records as rc
from pairlens.sources import training as tr
from workload import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Index settings of the document queries.
DOC_SIGS, DOC_BANDS, DOC_K = 100, 25, 7


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(col: str | Column, sep: str = " ") -> Column:
    return F.array_join(col, sep)


def big(col: Column) -> Column:
    return col.cast("bigint")


# -- sources ---------------------------------------------------------------------------------------


@query
def read_tagged_corpus(spark, sf):
    lines = fx.sentences(spark, sf).select(F.concat(F.lit(" "), "text", F.lit("\t")).alias("value"))
    return co.parse_tagged_corpus(lines).select("text")


@query
def read_system_output(spark, sf):
    facts = rc.parse_system_output(fx.run(spark, sf, fx.SYSTEM_RECORDS)).withColumn("rel_type", F.lit("founder2"))
    out = ev.orient_on_passive(ev.score_threshold(facts, 0.5))
    return out.select("e1", "e2", F.round("score", 9).alias("score"), "bef", "bet", "aft", "sentence", "passive")


@query
def read_classified_output(spark, sf):
    rows = rc.facts_of_classified(rc.parse_classified_output(fx.run(spark, sf, fx.CLASSIFIED_RECORDS)))
    return rows.select("e1", "e2", "rel_type", "bet")


@query
def read_kb_ntriples(spark, sf):
    return kbs.parse_ntriples(fx.run(spark, sf, fx.NTRIPLE_LINES)).select("e1", "e2")


@query
def quarantined_lines(spark, sf):
    return kbs.bad_lines(fx.run(spark, sf, fx.NTRIPLE_LINES), "dbpedia").select(F.col("value").alias("line"))


@query
def read_kb_yago(spark, sf):
    return kbs.parse_yago(fx.run(spark, sf, fx.YAGO_LINES)).select("e1", "e2")


@query
def read_kb_freebase(spark, sf):
    return kbs.parse_freebase(fx.run(spark, sf, fx.FREEBASE_LINES)).select("e1", "e2")


@query
def read_kb_manual(spark, sf):
    return kbs.parse_manual(fx.run(spark, sf, fx.MANUAL_LINES)).select("e1", "e2")


def all_kb_files(spark, sf, rel_type):
    return [
        kbs.parse_family(fx.run(spark, sf, fx.NTRIPLE_LINES), "dbpedia", rel_type, "dbpedia_location.txt"),
        kbs.parse_family(fx.run(spark, sf, fx.YAGO_LINES), "yago", rel_type, "yago_isLocatedIn.txt"),
        kbs.parse_family(fx.run(spark, sf, fx.FREEBASE_LINES), "freebase", rel_type, "freebase_place_founded.txt"),
        kbs.parse_family(fx.run(spark, sf, fx.MANUAL_LINES), "manual", rel_type),
    ]


@query
def load_kb(spark, sf):
    parts = all_kb_files(spark, sf, "has-installations") + all_kb_files(spark, sf, "has-installations2")
    return kbs.union_kb(parts)


@query
def union_kb(spark, sf):
    return kbs.union_kb(all_kb_files(spark, sf, "has-installations")).select("e1", "e2")


@query
def symmetric_relation(spark, sf):
    return kbs.parse_family(fx.run(spark, sf, fx.FREEBASE_LINES), "freebase", "spouse").select("e1", "e2")


@query
def normalise_kb_name(spark, sf):
    names = fx.run(spark, sf, "SELECT s_name || '_(id_' || CAST(s_suppkey AS STRING) || ')_x' AS raw FROM {supplier}")
    return names.select("raw", kbs.normalise_subject(F.col("raw")).alias("name"))


@query
def kb_multimap(spark, sf):
    return kbs.kb_multimap(fx.kb(spark, sf)).select("rel_type", "e1", joined("objects", "|").alias("objects"))


@query
def relation_catalogue(spark, sf):
    rows = fx.mentions(spark, sf).drop("rel_type").join(F.broadcast(fx.catalogue(spark)), ["e1_type", "e2_type"])
    return rows.groupBy("rel_type").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.max(big(F.size("unigrams"))).alias("unigrams"),
        F.max(big(F.size("bigrams"))).alias("bigrams"),
    )


@query
def read_training(spark, sf):
    return tr.parse_training(fx.run(spark, sf, fx.TRAINING_LINES))


@query
def read_features(spark, sf):
    rows = tr.parse_features(fx.run(spark, sf, fx.FEATURE_LINES))
    return rows.select("rel_id", "rel_type", joined("shingles", "|").alias("shingles"))


@query
def read_shingle_records(spark, sf):
    rows = rc.parse_shingle_records(fx.run(spark, sf, fx.SHINGLE_RECORDS))
    return rows.select("e1", "e2", "sentence", joined("shingles", "|").alias("shingles"))


@query
def read_unlabelled_sentences(spark, sf):
    return co.parse_unlabelled_sentences(fx.run(spark, sf, fx.COMMENTED_LINES))


@query
def facts_to_training(spark, sf):
    facts = tr.parse_evaluated_facts(fx.run(spark, sf, fx.POSITIVE_RECORDS))
    return tr.facts_to_training(facts).select("rel_type", "e1", "e2", "sentence")


def quarantine(name: str, good: str, bad: str, set_aside: Callable[[DataFrame], DataFrame]):
    """What a reader sets aside of good and bad rows."""

    def fn(spark, sf):
        return set_aside(fx.union(fx.run(spark, sf, good), fx.run(spark, sf, bad))).select("value")

    fn.__name__ = name
    return query(fn)


quarantine("quarantined_training", fx.TRAINING_LINES, fx.BAD_TRAINING_LINES, tr.bad_training)
quarantine("quarantined_features", fx.FEATURE_LINES, fx.BAD_FEATURE_LINES, tr.bad_features)
quarantine("quarantined_classified", fx.CLASSIFIED_RECORDS, fx.BAD_CLASSIFIED_RECORDS, rc.bad_classified_output)
quarantine("quarantined_shingles", fx.SHINGLE_RECORDS, fx.BAD_SHINGLE_RECORDS, rc.bad_shingle_records)
quarantine("quarantined_positives", fx.POSITIVE_RECORDS, fx.BAD_POSITIVE_RECORDS, tr.bad_evaluated_facts)


# -- text to mentions ------------------------------------------------------------------------------


@query
def strip_tags(spark, sf):
    return fx.sentences(spark, sf).select(tx.strip_tags(F.col("text")).alias("plain"))


@query
def tokenize(spark, sf):
    docs = fx.table(spark, sf, "documents")
    tokens = tx.tokenize(F.col("text"))
    out = docs.select("doc_id", let(tokens, lambda t: F.struct(F.size(t).alias("n"), F.array_join(t, " ").alias("s"))).alias("t"))
    return out.select("doc_id", big(F.col("t.n")).alias("n_tokens"), F.md5(F.col("t.s").cast("binary")).alias("tokens_md5"))


@query
def extract_entities(spark, sf):
    rows = fx.sentences(spark, sf).select(F.explode(tx.extract_entities(F.col("text"))).alias("e"))
    return rows.select("e.s", "e.ty")


@query
def has_two_entities(spark, sf):
    return fx.sentences(spark, sf).filter(tx.has_two_entities(F.col("text"))).select("text")


def located(spark, sf):
    text = F.col("text")
    found = let(tx.tokenize(tx.strip_tags(text)), lambda t: tx.locate_entities(tx.distinct_entities(text), t))
    return fx.sentences(spark, sf).select(found.alias("located"))


@query
def locate_entities(spark, sf):
    rows = located(spark, sf).select(F.explode_outer("located").alias("x")).filter("x IS NOT NULL")
    return rows.select("x.s", "x.ty", big(F.col("x.pos")).alias("pos"), big(F.col("x.len")).alias("len"))


@query
def distinct_entities(spark, sf):
    twice = fx.sentences(spark, sf).select(F.concat_ws(" ", "text", "text").alias("text"))
    rows = twice.select(F.explode(tx.distinct_entities(F.col("text"))).alias("e"))
    return rows.groupBy("e.s", "e.ty").agg(F.count(F.lit(1)).alias("sentences"))


def pairs(spark, sf):
    return located(spark, sf).select(F.explode(mn.neighbour_pairs(F.col("located"))).alias("p"))


def pair_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("p.a.s").alias("e1"), F.col("p.a.ty").alias("e1_type"), F.col("p.b.s").alias("e2"),
        F.col("p.b.ty").alias("e2_type"), big(F.col("p.b.pos") - F.col("p.a.pos")).alias("gap"),
    )


@query
def candidate_pairs(spark, sf):
    return pair_columns(pairs(spark, sf))


@query
def distance_filter(spark, sf):
    return pair_columns(pairs(spark, sf).filter(mn.pair_is_valid(F.col("p"))))


@query
def type_filter(spark, sf):
    return pair_columns(pairs(spark, sf).filter(mn.pair_is_valid(F.col("p"), [("PER", "ORG"), ("ORG", "ORG")])))


@query
def distinct_arguments(spark, sf):
    """The first name twice, then the last one: the repeated pair must go, the other stays."""
    span = "(<[A-Z]+>[^<]+</[A-Z]+>)"
    text = F.regexp_replace("text", f"^.*?{span}.*{span}[^<]*$", "$1 met $1 , met $2 .")
    return mn.extract_mentions(fx.sentences(spark, sf).select(text.alias("text"))).select("e1", "e2")


def mention_text(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *more, "e1", "e1_type", "e2", "e2_type", *[joined(c).alias(c) for c in ("bef", "bet", "aft")]
    )


@query
def extract_mentions(spark, sf):
    return mention_text(fx.mentions(spark, sf), "sent_id")


@query
def context_windows(spark, sf):
    rows = mn.extract_mentions(fx.sentences(spark, sf), mn.FEATURE_WINDOW)
    return mention_text(rows).distinct()


@query
def relational_bet(spark, sf):
    docs = fx.sentences(spark, sf).select(F.regexp_extract("text", r"</[A-Z]+> (.*?) <[A-Z]+>", 1).alias("bet"))
    rows = docs.select("bet", tx.is_relational(tx.tokenize(F.col("bet"))).alias("relational"))
    return rows.groupBy("bet", "relational").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_mentions(spark, sf):
    return mention_text(mn.distinct_mentions(fx.mentions(spark, sf)), "n")


@query
def adjacent_entities(spark, sf):
    """Neighbours found with a window over exploded entities, the relational form of candidate_pairs."""
    from pyspark.sql import Window

    rows = located(spark, sf).select(F.monotonically_increasing_id().alias("rid"), "located")
    flat = rows.select("rid", F.explode("located").alias("x")).select("rid", "x.*")
    over = Window.partitionBy("rid").orderBy("pos")
    nxt = flat.withColumn("e2", F.lead("s").over(over)).filter(F.col("e2").isNotNull())
    return nxt.groupBy(F.col("s").alias("e1"), "e2").agg(F.count(F.lit(1)).alias("n"))


@query
def order_positions(spark, sf):
    return located(spark, sf).select(joined(F.transform("located", lambda x: x["pos"].cast("string"))).alias("positions"))


@query
def known_pair_locations(spark, sf):
    lines = tr.parse_training(fx.run(spark, sf, fx.TRAINING_LINES))
    first = F.get(mn.known_pair_contexts(F.col("sentence"), F.col("e1"), F.col("e2")), F.lit(0))
    rows = lines.select("rel_id", first.alias("m"))
    return rows.select("rel_id", *[joined(F.col(f"m.{c}")).alias(c) for c in ("bef", "bet", "aft")])


@query
def token_bigrams(spark, sf):
    docs = fx.table(spark, sf, "documents")
    rows = docs.select(F.explode(tx.token_bigrams(tx.tokenize(F.col("text")))).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


# -- knowledge base and corpus support -------------------------------------------------------------


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/pairlens/{name}-{uuid.uuid4().hex}"


def written(name: str, rows: DataFrame, write: Callable[..., None], *more) -> DataFrame:
    """What a sink wrote into the shared folder."""
    path = new_folder(rows.sparkSession, name)
    write(rows, path, *more)
    return rows.sparkSession.read.parquet(path)


def stats(spark, sf):
    return ev.corpus_statistics(fx.sentences(spark, sf), fx.catalogue(spark), fx.types())


def evaluation(spark, sf):
    return ev.evaluate(fx.facts(spark, sf), fx.kb(spark, sf), stats(spark, sf), fx.catalogue(spark))


FACT_COLUMNS = ["rel_type", "e1", "e2", "score", "bef", "bet", "aft", "sentence"]


@query
def score_threshold(spark, sf):
    facts = rc.parse_system_output(fx.run(spark, sf, fx.SYSTEM_RECORDS))
    return ev.score_threshold(facts, 0.5).select("e1", "e2", "bet")


@query
def orient_arguments(spark, sf):
    facts = fx.run(spark, sf, fx.ORDER_FACTS).withColumn(
        "rel_type", F.when(F.col("o_orderkey") % 2 == 0, "founder").otherwise("founder2")
    )
    return ev.orient_on_passive(facts).select("o_orderkey", "e1", "e2")


@query
def distinct_facts(spark, sf):
    return ev.distinct_facts(fx.facts(spark, sf)).select(*FACT_COLUMNS)


@query
def rank_facts(spark, sf):
    return ev.rank_facts(ev.distinct_facts(fx.facts(spark, sf))).select("rel_type", "e1", "e2", "score", "sentence")


@query
def facts_in_kb(spark, sf):
    return ev.in_kb(ev.distinct_facts(fx.facts(spark, sf)), fx.kb(spark, sf)).select(*FACT_COLUMNS)


@query
def facts_not_in_kb(spark, sf):
    return ev.not_in_kb(ev.distinct_facts(fx.facts(spark, sf)), fx.kb(spark, sf)).select(*FACT_COLUMNS)


def superset(spark, sf):
    found = sp.flag_near_mentions(fx.sentences(spark, sf).select("text"), mn.EVALUATION_WINDOW, fx.types())
    return sp.with_relations(sp.superset_of(found), fx.catalogue(spark))


@query
def keyword_context_filter(spark, sf):
    return mention_text(superset(spark, sf).filter("word_in_context"), "rel_type", "n")


@query
def superset_in_kb(spark, sf):
    return mention_text(ev.in_kb(superset(spark, sf).filter("word_in_context"), fx.kb(spark, sf)), "rel_type")


@query
def superset_not_in_kb(spark, sf):
    return mention_text(ev.not_in_kb(superset(spark, sf).filter("word_in_context"), fx.kb(spark, sf)), "rel_type")


@query
def proximity_hits(spark, sf):
    return sp.proximity_hits(fx.sentences(spark, sf).select("sent_id", "text")).select("sent_id", *sp.PAIR, "phrase")


@query
def phrase_counts(spark, sf):
    return sp.phrase_counts(sp.proximity_hits(fx.sentences(spark, sf).select("text")))


@query
def pmi_relational_words(spark, sf):
    rows = stats(spark, sf).pairs.filter(sp.well_supported(F.col("total"), F.col("with_word")))
    return rows.select("rel_type", "e1", "e2", "total", "with_word")


@query
def pmi_exact_phrase(spark, sf):
    return evaluation(spark, sf).verdicts.select("rel_type", "e1", "e2", "bet", "phrase_hits", "pair_hits", "supported")


@query
def pmi_for_facts(spark, sf):
    counts = sp.phrase_counts(sp.proximity_hits(fx.sentences(spark, sf).select("text"))).filter("phrase = ''")
    kinds = F.broadcast(fx.catalogue(spark).select("rel_type", "e1_type", "e2_type"))
    facts = ev.triples_of(ev.distinct_facts(fx.facts(spark, sf))).join(kinds, "rel_type")
    return facts.join(counts.drop("phrase"), sp.PAIR).select("rel_type", "e1", "e2", "bet", "n_facts", "hits")


@query
def verdict_fallback(spark, sf):
    rows = evaluation(spark, sf).verdicts
    share = F.col("phrase_hits") / F.nullif(F.col("pair_hits"), F.lit(0))
    return rows.filter(F.col("supported") & (share < sp.PMI_THRESHOLD)).select("rel_type", "e1", "e2", "bet")


@query
def verdict_join_back(spark, sf):
    return evaluation(spark, sf).fact_regions().select(*FACT_COLUMNS, "region")


@query
def missed_kb_facts(spark, sf):
    return ev.missed_pairs(evaluation(spark, sf).ledger).filter("region = 'c'").select("rel_type", "e1", "e2")


@query
def missed_new_facts(spark, sf):
    return ev.missed_pairs(evaluation(spark, sf).ledger).filter("region = 'd'").select("rel_type", "e1", "e2")


@query
def distinct_pairs(spark, sf):
    return ev.missed_pairs(evaluation(spark, sf).ledger).select("rel_type", "region", "e1", "e2")


@query
def ground_truth_estimate(spark, sf):
    return ev.ground_truth(evaluation(spark, sf).ledger)


@query
def region_sizes(spark, sf):
    return evaluation(spark, sf).sizes


@query
def evaluation_metrics(spark, sf):
    rows = evaluation(spark, sf).metrics
    return rows.select("rel_type", "s", "a", "b", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def write_positives(spark, sf):
    return written("positives", evaluation(spark, sf).fact_regions(), sk.write_positives).select("rel_type", "e1", "e2", "score", "sentence", "bet")


@query
def write_negatives(spark, sf):
    return written("negatives", evaluation(spark, sf).fact_regions(), sk.write_negatives).select("rel_type", "e1", "e2", "score", "sentence", "bet")


@query
def union_positives(spark, sf):
    rows = evaluation(spark, sf).fact_regions().filter(F.col("region").isin("a", "b"))
    return rows.groupBy("rel_type", "region").agg(F.count(F.lit(1)).alias("facts"))


@query
def inspect_high_pmi(spark, sf):
    return sk.inspect_high_pmi(high_pmi(spark, sf))


def high_pmi(spark, sf):
    """Keyword mentions outside the knowledge base whose pair the corpus supports."""
    outside = ev.not_in_kb(superset(spark, sf).filter("word_in_context"), fx.kb(spark, sf))
    good = stats(spark, sf).pairs.filter(sp.well_supported(F.col("total"), F.col("with_word")))
    return outside.join(good.select("rel_type", "e1", "e2"), ["rel_type", "e1", "e2"], "left_semi")


def not_again() -> DataFrame:
    raise AssertionError("a stored intermediate was built a second time")


@query
def materialise_superset(spark, sf):
    """Counted evidence stored for two windows; both are read from the store."""
    corpus, folder = fx.sentences(spark, sf), st.Store(new_folder(spark, "store"), "derived sentences")
    windows = (mn.EVALUATION_WINDOW, mn.FEATURE_WINDOW)
    for window in windows:
        ev.corpus_statistics(corpus, fx.catalogue(spark), fx.types(), store=folder, window=window)
    out = []
    for window in windows:
        params = folder.key(corpus, window=window, types=sorted(set(fx.types())))
        rows = sp.superset_in(st.materialise_superset(spark, folder.base, params, not_again))
        per = rows.groupBy("e1_type", "e2_type").agg(F.count(F.lit(1)).alias("mentions"), F.sum("n").alias("n"))
        out.append(per.select(F.lit(window).alias("context_window"), "*"))
    return fx.union(*out)


@query
def materialise_kb_split(spark, sf):
    """Pairs inside and outside the knowledge base, stored for all relations and for one, and read back by evaluations."""
    corpus, kb, folder = fx.sentences(spark, sf), fx.kb(spark, sf), st.Store(new_folder(spark, "store"), "derived sentences")
    out = []
    for name, relations in (("all", fx.RELATIONS_IN_USE), ("one", ["has-installations"])):
        words = cat.relation_catalogue(spark, relations)
        found = ev.corpus_statistics(corpus, words, cat.argument_types(relations), store=folder)
        ev.corpus_split(found, kb)
        params = {**found.params, "kb": folder.key(kb)}
        rows = st.materialise_kb_split(spark, folder.base, params, not_again)
        per = rows.groupBy("rel_type", "known").agg(F.count(F.lit(1)).alias("pairs"), F.sum("keyword_mentions").alias("keyword_mentions"))
        out.append(per.select(F.lit(name).alias("words"), "*"))
    return fx.union(*out)


@query
def materialise_high_pmi(spark, sf):
    """Supported mentions outside the knowledge base, stored for two thresholds."""
    corpus, kb, folder = fx.sentences(spark, sf), fx.kb(spark, sf), st.Store(new_folder(spark, "store"), "derived sentences")
    found = ev.corpus_statistics(corpus, fx.catalogue(spark), fx.types(), store=folder)
    thresholds = (sp.PMI_THRESHOLD, 0.9)
    for threshold in thresholds:
        ev.high_pmi(found, kb, fx.catalogue(spark), threshold)
    out = []
    for threshold in thresholds:
        params = {**found.params, "kb": folder.key(kb), "threshold": threshold}
        rows = sk.inspect_high_pmi(st.materialise_high_pmi(spark, folder.base, params, not_again))
        out.append(rows.select(F.lit(threshold).alias("threshold"), "*"))
    return fx.union(*out)


@query
def data_checks(spark, sf):
    return ck.data_checks(evaluation(spark, sf))


# -- features --------------------------------------------------------------------------------------


def tagged_bets(spark, sf):
    rows = fx.mentions(spark, sf).select("bet").groupBy("bet").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("tagged", tg.tag_tokens(F.col("bet")))


def tagged_text(col: Column) -> Column:
    return joined(F.transform(col, lambda t: F.concat_ws("/", t["tok"], t["tag"], t["lemma"])))


@query
def tag_and_lemmatise(spark, sf):
    docs = fx.table(spark, sf, "documents")
    rows = docs.select(F.explode(tg.tag_tokens(tx.tokenize(F.col("text")))).alias("t"))
    return rows.groupBy("t.tok", "t.tag", "t.lemma").agg(F.count(F.lit(1)).alias("n"))


@query
def tag_with_lexicon(spark, sf):
    words = fx.run(spark, sf, "SELECT DISTINCT lower(p_type) AS token, 'NNP' AS tag, 'kind' AS lemma FROM {part}")
    rows = fx.run(spark, sf, "SELECT p_partkey, split(p_name || ' ' || lower(p_type), ' ') AS toks FROM {part}")
    out = tg.tag_with_lexicon(rows, "p_partkey", "toks", words)
    return out.select("p_partkey", joined(F.transform("tagged", lambda t: F.concat_ws("/", t["tok"], t["tag"]))).alias("tagged"))


@query
def relation_phrase(spark, sf):
    rows = tagged_bets(spark, sf)
    return rows.select(joined("bet").alias("bet"), tagged_text(ph.relation_phrase(F.col("tagged"))).alias("phrase"), "n")


@query
def relation_phrase_universal(spark, sf):
    phrases = ph.relation_phrases_universal(F.col("tagged"))
    text = F.transform(phrases, lambda p: F.array_join(F.transform(p, lambda t: t["tok"]), " "))
    return tagged_bets(spark, sf).select(joined("bet").alias("bet"), joined(text, "|").alias("phrases"))


@query
def relation_phrase_raw(spark, sf):
    docs = fx.table(spark, sf, "documents")
    phrase = ph.relation_phrase(tg.tag_tokens(tx.tokenize(F.col("text"))))
    words = let(phrase, lambda p: F.struct(big(F.size(p)).alias("n"), F.md5(joined(F.transform(p, lambda t: t["tok"]))).alias("text")))
    return docs.select("doc_id", words.alias("p")).select("doc_id", F.col("p.n").alias("phrase_tokens"), F.col("p.text").alias("phrase_md5"))


@query
def passive_voice(spark, sf):
    passive = ph.is_passive(ph.relation_phrase(F.col("tagged")))
    return tagged_bets(spark, sf).select(joined("bet").alias("bet"), passive.alias("passive"))


def per_bet(name: str, build: Callable[[Column], Column]):
    def fn(spark, sf):
        return tagged_bets(spark, sf).select(joined("bet").alias("bet"), joined(build(F.col("tagged"))).alias("shingles"))

    fn.__name__ = name
    return query(fn)


verb_shingles = per_bet("verb_shingles", lambda t: sh.verb_shingles(t, "BET"))
preposition_shingles = per_bet("preposition_shingles", sh.preposition_shingles)
noun_shingles = per_bet("noun_shingles", sh.noun_shingles)
phrase_shingles = per_bet("phrase_shingles", sh.phrase_shingles)


@query
def entity_type_shingles(spark, sf):
    rows = fx.mentions(spark, sf).select(F.explode(sh.entity_type_shingles(F.col("e1_type"), F.col("e2_type"))).alias("shingle"))
    return rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


@query
def char_4grams(spark, sf):
    docs = fx.table(spark, sf, "documents")

    def marked(grams: Column) -> Column:
        every = F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(False).alias("once")))
        return F.concat(every, F.transform(F.array_distinct(grams), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("once"))))

    # A document's distinct grams are marked in its row, so both counts are one aggregate and no pair is shuffled.
    rows = docs.select(F.explode(let(sh.char_ngrams(F.col("text"), "BET"), marked)).alias("g"))
    return rows.groupBy("g.gram").agg(F.count_if(~F.col("g.once")).alias("n"), F.count_if("g.once").alias("docs"))


@query
def assemble_shingles(spark, sf):
    rows = mn.extract_mentions(fx.sentences(spark, sf), mn.FEATURE_WINDOW)
    rows = rows.groupBy("e1_type", "e2_type", "bef", "bet", "aft").agg(F.count(F.lit(1)).alias("n"))
    out = cl.mention_features(rows)
    return out.select("e1_type", "e2_type", *[joined(c).alias(c) for c in ("bef", "bet", "aft", "shingles")], "n")


# -- similarity classification ---------------------------------------------------------------------


def doc_features(spark, sf):
    """Whole documents as bags of character 4-grams; labelled ones have a ``rel_type``."""
    rows = fx.passages(spark, sf)
    return rows.select("rel_id", "rel_type", sh.char_ngrams(F.col("text"), "BET").alias("shingles"))


def doc_signatures(spark, sf):
    return nb.signatures(doc_features(spark, sf), DOC_SIGS)


@query
def hash_family(spark, sf):
    rows = doc_features(spark, sf).select(F.explode(mh.shingle_hashes(F.col("shingles"))).alias("h"))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))


@query
def minhash_signature(spark, sf):
    # A signature is never empty; the outer form keeps Spark from testing for that with a second run of the kernel.
    rows = doc_signatures(spark, sf)
    return rows.select("rel_id", F.posexplode_outer("sig").alias("position", "value")).select(
        "rel_id", big(F.col("position")).alias("position"), big(F.col("value")).alias("value")
    )


@query
def sort_band_chunk(spark, sf):
    chunks = mh.band_chunks(F.col("sig"), DOC_SIGS, DOC_BANDS)
    rows = doc_signatures(spark, sf).select("rel_id", F.posexplode(chunks).alias("band", "chunk"))
    return rows.select("rel_id", big(F.col("band")).alias("band"), joined(F.col("chunk").cast("array<string>")).alias("chunk"))


@query
def band_keys(spark, sf):
    rows = nb.band_rows(doc_signatures(spark, sf), DOC_SIGS, DOC_BANDS, ["rel_id"])
    groups = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("rel_id").alias("first_id"))
    return groups.select(big(F.col("band")).alias("band"), "members", "first_id")


def doc_index(spark, sf):
    signed = materialise(doc_signatures(spark, sf), "doc-signatures")
    labelled = signed.filter(F.col("rel_type").isNotNull())
    buckets = nb.last_writers(nb.band_rows(labelled, DOC_SIGS, DOC_BANDS, ["rel_id"]))
    queries = signed.filter(F.col("rel_type").isNull()).select(F.col("rel_id").alias("query_id"), "sig")
    return labelled, buckets, queries


def doc_candidates(spark, sf):
    labelled, buckets, queries = doc_index(spark, sf)
    met = nb.candidates(nb.band_rows(queries, DOC_SIGS, DOC_BANDS, ["query_id"]), buckets, "query_id")
    return labelled, queries, met


def doc_scored(spark, sf):
    labelled, queries, met = doc_candidates(spark, sf)
    return nb.scored_candidates(met, queries, labelled, DOC_SIGS, "query_id")


@query
def bucket_last_writer(spark, sf):
    _, buckets, _ = doc_index(spark, sf)
    return buckets.select(big(F.col("band")).alias("band"), "rel_id")


@query
def band_join(spark, sf):
    return doc_candidates(spark, sf)[2]


@query
def candidate_signatures(spark, sf):
    labelled, _, met = doc_candidates(spark, sf)
    rows = met.join(labelled.select("rel_id", "rel_type", "sig"), "rel_id")
    return rows.select("query_id", "rel_id", "rel_type", big(F.get("sig", F.lit(0))).alias("first_value"))


@query
def signature_similarity(spark, sf):
    return doc_scored(spark, sf).select("query_id", "rel_id", F.round("similarity", 9).alias("similarity"))


@query
def top_k_neighbours(spark, sf):
    rows = nb.top_k_neighbours(doc_scored(spark, sf), DOC_K, ["query_id"])
    return rows.select("query_id", "rel_id", big(F.col("rank")).alias("rank"))


@query
def vote_counts(spark, sf):
    top = nb.top_k_neighbours(doc_scored(spark, sf), DOC_K, ["query_id"])
    return nb.vote_counts(top, ["query_id"]).select("query_id", "rel_type", "votes")


@query
def knn_vote(spark, sf):
    top = nb.top_k_neighbours(doc_scored(spark, sf), DOC_K, ["query_id"])
    return nb.majority(nb.vote_counts(top, ["query_id"]), ["query_id"]).select("query_id", "rel_type", "votes")


@query
def build_lsh_index(spark, sf):
    index = cl.build_lsh_index(doc_features(spark, sf).filter("rel_type IS NOT NULL"), DOC_SIGS, DOC_BANDS)
    return index.buckets.groupBy("rel_id").agg(F.count(F.lit(1)).alias("buckets"))


@query
def classify_features(spark, sf):
    features = doc_features(spark, sf)
    index = cl.build_lsh_index(features.filter("rel_type IS NOT NULL"), DOC_SIGS, DOC_BANDS)
    asked = features.filter("rel_type IS NULL").drop("rel_type").withColumnRenamed("rel_id", "query_id")
    return cl.classify_features(asked, index, DOC_K)


def trained(spark, sf):
    """Index over sentences of all orders and order lines, labelled by their phrase, one label in eleven wrong."""
    return cl.train_index(tr.parse_training(fx.run(spark, sf, fx.LABELLED_LINES)))


def classified(spark, sf):
    return cl.classify_mentions(fx.sentences(spark, sf), trained(spark, sf))


@query
def classify_mentions(spark, sf):
    return classified(spark, sf)


@query
def write_classified(spark, sf):
    return written("classified", classified(spark, sf), sk.write_classified).select("e1", "e2", "sentence", "rel_type")


@query
def write_by_relation(spark, sf):
    """Rows of every folder; a rare relation is one file, whatever the tasks that found it."""
    rows = written("by-relation", classified(spark, sf), sk.write_by_relation)
    return rows.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query
def evaluate_classified(spark, sf):
    rows = materialise(classified(spark, sf), "classified")
    done = bs.evaluate_classified(rows, fx.kb(spark, sf), stats(spark, sf), fx.catalogue(spark))
    return done.metrics.select("rel_type", "s", "a", "b", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def write_wrong(spark, sf):
    rows = materialise(classified(spark, sf), "classified")
    done = bs.evaluate_classified(rows, fx.kb(spark, sf), stats(spark, sf), fx.catalogue(spark))
    return written("wrong", done.fact_regions(), sk.write_wrong).select("rel_type", "e1", "e2", "sentence", "bet")


@query
def write_features(spark, sf):
    features, _ = cl.training_features(tr.parse_training(fx.run(spark, sf, fx.TRAINING_LINES)))
    rows = written("features", features, sk.write_features)
    return rows.select("rel_id", "rel_type", big(F.size("shingles")).alias("shingles"))


def swept(spark, sf):
    features, _ = cl.training_features(tr.parse_training(fx.run(spark, sf, fx.LABELLED_LINES)))
    return sw.parameter_sweep(
        features, *cl.context_features(fx.sentences(spark, sf)), fx.kb(spark, sf), stats(spark, sf), fx.catalogue(spark)
    )


@query
def parameter_sweep(spark, sf):
    rows = swept(spark, sf)
    return rows.select("sigs", "bands", "k", "rel_type", "s", "a", "b", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def macro_average(spark, sf):
    """Mean F1 per setting, where a setting is a score threshold on the same facts."""
    base = evaluation(spark, sf).fact_regions()
    per = base.select("*", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5), F.lit(7))).alias("k")).filter(
        F.col("score") >= 0.5 + F.col("k") / 20
    )
    sizes = per.groupBy("k", "rel_type").agg(
        F.count(F.lit(1)).alias("s"), F.count_if(F.col("region").isin("a", "b")).alias("good")
    )
    f1 = F.col("good") / F.col("s")
    results = sizes.select(F.lit(200).alias("sigs"), F.lit(25).alias("bands"), "k", "rel_type", f1.alias("f1"))
    return sw.macro_average(results).select("k", F.round("macro_f1", 9).alias("macro_f1"), "relations")


@query
def collect_results(spark, sf):
    metrics = evaluation(spark, sf).metrics
    setting = [F.lit(cl.DEFAULT_SIGS).alias("sigs"), F.lit(cl.DEFAULT_BANDS).alias("bands"), F.lit(cl.DEFAULT_K).alias("k")]
    rows = sk.collect_results([metrics.select(*setting, "rel_type", "precision", "recall", "f1")])
    return rows.select("sigs", "bands", "k", "rel_type", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def bootstrap_loop(spark, sf):
    # Both evaluations are against the same corpus, which is counted once.
    corpus = stats(spark, sf)
    first = ev.evaluate(fx.facts(spark, sf), fx.kb(spark, sf), corpus, fx.catalogue(spark), stored=True)
    done = bs.bootstrap_loop(first, fx.sentences(spark, sf), fx.kb(spark, sf), corpus, fx.catalogue(spark))
    return done.metrics.select("rel_type", "s", "a", "b", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def tag_with_model(spark, sf):
    """Tags of all sentences by the trained model, whole sentences at a time."""
    worded = fx.sentences(spark, sf).select("sent_id", tx.tokenize(tx.strip_tags(F.col("text"))).alias("words"))
    tagged = worded.select("sent_id", tg.tag_tokens(F.col("words"), tagger.model_tagger()).alias("t"))
    return tagged.select("sent_id", F.array_join(F.transform("t", lambda t: F.concat_ws("/", t["tok"], t["tag"], t["lemma"])), " ").alias("tagged"))


@query
def mention_features_whole(spark, sf):
    """Features of distinct contexts that were cut from sentences tagged as a whole, with the mentions that have them."""
    keyed, features = cl.context_features(fx.sentences(spark, sf), tagger.model_tagger(), whole=True)
    counted = keyed.groupBy("bag").agg(F.count(F.lit(1)).alias("mentions"))
    return features.join(counted, "bag").select("mentions", F.array_join(F.array_sort("shingles"), " ").alias("shingles"))
