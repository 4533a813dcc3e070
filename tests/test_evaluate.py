"""The evaluation and the classifier against plain Python on small inputs, and invariants on the derived ones."""
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlens.operators import neighbours as nb
from pairlens.operators import support as sp
from pairlens.plans import bootstrap as bs
from pairlens.plans import classify as cl
from pairlens.plans import evaluate as ev
from pairlens.plans import sweep as sw
from pairlens.sources.catalogue import relation_catalogue
from workload import fixtures as fx


def corpus(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def hits(spark, *texts):
    return [(r.e1, r.e2, r.phrase) for r in sp.proximity_hits(corpus(spark, *texts)).collect()]


def test_proximity_hits(spark):
    assert hits(spark, "<ORG>A b c</ORG> is in <LOC>X</LOC>") == [("A b c", "X", "is in")]
    assert hits(spark, "<ORG>A</ORG> one two three four five six <LOC>X</LOC>") == []
    # A name counts as one position; the markup of a name in between makes the phrase too long.
    got = dict(((a, b), p) for a, b, p in hits(spark, "<ORG>A</ORG> of <ORG>B</ORG> in <LOC>X</LOC>"))
    assert got == {("A", "B"): "of", ("B", "X"): "in", ("A", "X"): None}
    # The phrase is what lies between the last tags; one hit per sentence.
    again = hits(spark, "<ORG>A</ORG> in <LOC>X</LOC> . <ORG>A</ORG> near <LOC>X</LOC>")
    assert [p for a, b, p in again if (a, b) == ("A", "X")] == ["near"]
    assert hits(spark, "<ORG>A</ORG> in <LOC>X</LOC> and <ORG>A</ORG>")[0] == ("A", "X", None)


def small(spark):
    text = ["<ORG>A</ORG> is based in <LOC>X</LOC> ."] * 3 + ["<ORG>A</ORG> left <LOC>X</LOC> ."]
    text += ["<ORG>B</ORG> headquarters <LOC>Y</LOC> .", "<ORG>B</ORG> left <LOC>Y</LOC> .", "<ORG>C</ORG> is based in <LOC>Z</LOC> ."]
    text += ["<ORG>D</ORG> has offices in <LOC>W</LOC> ."]
    kb = spark.createDataFrame([("has-installations", "C", "Z"), ("has-installations", "K", "N")], "rel_type string, e1 string, e2 string")
    rows = [("A", "X", "is based in"), ("A", "X", "left"), ("B", "Y", "headquarters"), ("B", "Y", "left"), ("Q", "R", "left")]
    facts = spark.createDataFrame(
        [("has-installations", a, b, 0.9, "", bet, "", f"{a} {bet} {b}", False) for a, b, bet in rows],
        "rel_type string, e1 string, e2 string, score double, bef string, bet string, aft string, sentence string, passive boolean",
    )
    cat = relation_catalogue(spark, ["has-installations"])
    stats = ev.corpus_statistics(corpus(spark, *text), cat, [("ORG", "LOC")])
    return ev.evaluate(facts, kb, stats, cat)


def test_small_evaluation(spark):
    done = small(spark)
    region = {(r.e1, r.bet): r.region for r in done.fact_regions().collect()}
    assert region == {
        ("A", "is based in"): "a",  # 3 of 4 hits
        ("A", "left"): "not_found",
        ("B", "headquarters"): "a",  # half the hits, but a relational word
        ("B", "left"): "not_found",
        ("Q", "left"): "not_found",  # no hits at all
    }
    missed = {(r.e1, r.region) for r in ev.missed_pairs(done.ledger).collect()}
    assert missed == {("C", "c"), ("D", "d")}
    kept = {(r.e1, r.region) for r in ev.missed_pairs(done.ledger, subtract=False).collect()}
    assert kept == {("C", "c"), ("D", "d"), ("A", "d")}
    m = done.metrics.first()
    assert (m.s, m.a, m.b, m.c_pairs, m.d_pairs, m.g_pairs) == (5, 2, 0, 1, 1, 4)
    assert (round(m.precision, 6), round(m.recall, 6)) == (0.4, 0.5)


def test_corpus_is_read_and_counted_once(spark, tmp_path):
    """One scan and one aggregate yield what the two separate passes yield; the metrics read no corpus any more."""
    texts = ["<ORG>A</ORG> is based in <LOC>X</LOC> ."] * 3 + ["<ORG>A</ORG> left <LOC>X</LOC> and <ORG>B</ORG> ."]
    texts += ["<ORG>A</ORG> and <LOC>X</LOC> .", "no names", "", "<ORG>A</ORG> " + "very " * 5000 + "<LOC>X</LOC>"]
    spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").write.parquet(str(tmp_path / "corpus"))
    sentences = spark.read.parquet(str(tmp_path / "corpus"))
    types = [("ORG", "LOC")]
    evidence = sp.corpus_evidence(sentences, 2, types)
    plan = evidence._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate explode") == 1
    assert plan.count("Exchange") == 1

    def same(left, right):
        return sorted(map(str, left.collect())) == sorted(map(str, right.select(*left.columns).collect()))

    assert same(sp.superset_in(evidence), sp.superset_of(sp.flag_near_mentions(sentences, 2, types)))
    assert same(sp.phrases_in(evidence), sp.phrase_counts(sp.proximity_hits(sentences)))
    assert sp.superset_in(evidence).count() > 1 and sp.phrases_in(evidence).count() > 4
    cat = relation_catalogue(spark, ["has-installations"])
    stats = ev.corpus_statistics(sentences, cat, types)
    read = {f.rsplit("/", 2)[1] for frame in (stats.pairs, stats.phrases) for f in frame.inputFiles()}
    assert all("corpus" not in name for name in read)


def test_bootstrap_counts_the_corpus_once(spark, sf, monkeypatch):
    """The loop's two evaluations read the same statistics, and the facts of the first are made once."""
    from workload.queries import QUERIES

    counted, built = [], []
    monkeypatch.setattr(sp, "corpus_evidence", lambda *a, f=sp.corpus_evidence: counted.append(1) or f(*a))
    monkeypatch.setattr(ev, "fact_regions", lambda facts, *a, f=ev.fact_regions: built.append(facts) or f(facts, *a))
    done = QUERIES["bootstrap_loop"](spark, sf)
    assert counted == [1] and len(built) == 1
    assert "ArrowEvalPython" not in built[0]._jdf.queryExecution().executedPlan().toString()
    assert done.count() == len(fx.RELATIONS_IN_USE)


def test_store_tells_inputs_and_parameters_apart(spark, tmp_path):
    from pairlens.operators import store as st

    def rewrite(*texts):
        corpus(spark, *texts).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "corpus"))
        return spark.read.parquet(str(tmp_path / "corpus"))

    def never():
        raise AssertionError("built again")

    cat, types = relation_catalogue(spark, ["has-installations"]), [("ORG", "LOC")]
    kb_path = str(tmp_path / "kb")
    spark.createDataFrame([("has-installations", "A", "X")], "rel_type string, e1 string, e2 string").write.parquet(kb_path)
    kb = spark.read.parquet(kb_path)
    store = st.Store(str(tmp_path / "store"))
    texts = ["<ORG>A</ORG> is based in <LOC>X</LOC>", "<ORG>B</ORG> is based in <LOC>Y</LOC>", "<ORG>C</ORG> left <LOC>Z</LOC>"]
    first = rewrite(*texts)
    stats = ev.corpus_statistics(first, cat, types, store=store)
    facts = spark.createDataFrame(
        [("has-installations", "A", "X", 0.9, "", "is based in", "", "s", False)],
        "rel_type string, e1 string, e2 string, score double, bef string, bet string, aft string, sentence string, passive boolean",
    )
    names = ["s", "a", "b", "c_pairs", "d_pairs", "precision", "recall"]
    plain = ev.evaluate(facts, kb, ev.corpus_statistics(first, cat, types), cat).metrics.select(*names).collect()
    kept = ev.evaluate(facts, kb, stats, cat).metrics.select(*names)
    assert kept.collect() == plain and plain[0].d_pairs == 1
    assert {r.e1 for r in ev.high_pmi(stats, kb, cat).collect()} == {"B"}
    # The same parameters are read; a changed file, knowledge base or threshold is not served from what is there.
    params = store.key(first, window=2, types=types)
    assert st.materialise_superset(spark, store.base, params, never).count() > 0
    with pytest.raises(AssertionError):
        st.materialise_high_pmi(spark, store.base, {**stats.params, "kb": store.key(kb), "threshold": 0.9}, never)
    second = rewrite(*texts[:1], "<ORG>D</ORG> is based in <LOC>Y</LOC> now")
    assert store.key(second) != {k: v for k, v in params.items() if k in ("files", "version")}
    again = ev.corpus_statistics(second, cat, types, store=store)
    assert {r.e1 for r in again.superset.collect()} == {"A", "D"}
    # A folder whose manifest is not the one asked for is built again.
    path = again.superset.inputFiles()[0].split("/superset/")[1].split("/")[0]
    st.write_manifest(spark, f"{store.base}/superset/{path}", "{}")
    assert {r.e1 for r in ev.corpus_statistics(second, cat, types, store=store).superset.collect()} == {"A", "D"}
    with pytest.raises(ValueError):
        store.key(corpus(spark, "x"))


def test_write_by_relation_splits_and_joins(spark, tmp_path):
    """A dominant relation is spread, a rare one is one file; null and copies stay."""
    from pairlens.operators import sinks as sk

    rows = spark.range(4000, numPartitions=8).selectExpr(
        "CASE WHEN id < 3000 THEN 'owns' WHEN id < 3990 THEN 'founder' WHEN id < 3995 THEN 'spouse' END AS rel_type", "'a' AS e1"
    )
    sk.write_by_relation(rows, str(tmp_path / "by"), 1000)
    back = spark.read.parquet(str(tmp_path / "by"))
    assert {(r.rel_type, r["count"]) for r in back.groupBy("rel_type").count().collect()} == {
        ("owns", 3000), ("founder", 990), ("spouse", 5), (None, 5)
    }
    files = [f for f in back.inputFiles() if "rel_type=spouse" in f]
    assert len(files) == 1 and len([f for f in back.inputFiles() if "rel_type=owns" in f]) >= 3


def test_invariants(spark, sf):
    cat, kb = fx.catalogue(spark), fx.kb(spark, sf)
    stats = ev.corpus_statistics(fx.sentences(spark, sf), cat, fx.types())
    done = ev.evaluate(fx.facts(spark, sf), kb, stats, cat)
    facts = done.facts.cache()
    assert facts.count() == ev.in_kb(facts, kb).count() + ev.not_in_kb(facts, kb).count()
    regions = done.fact_regions().cache()
    assert regions.count() == facts.count() and regions.filter("region IS NULL").count() == 0
    missed = ev.missed_pairs(done.ledger)
    for ours, theirs in (("c", "b"), ("d", "a")):
        overlap = missed.filter(F.col("region") == ours).join(regions.filter(F.col("region") == theirs), ev.PAIR_KEY, "left_semi")
        assert overlap.count() == 0
    assert done.ledger.filter("with_word > total").count() == 0


def test_skewed_pair_is_merged_before_joins(spark):
    """A pair with most of the facts is one triple per BET."""
    rows = spark.range(5000).selectExpr(
        "'owns' rel_type", "'A' e1", "if(id % 3 = 0, 'B', concat('C', id)) e2", "'buys' bet", "0.9D score", "'' bef", "'' aft",
        "concat('s', id) sentence", "false passive",
    )
    triples = ev.triples_of(ev.distinct_facts(rows))
    assert triples.filter("e2 = 'B'").first().n_facts == 1667 and triples.count() == 3334


def plain_knn(labelled, queries, n_sigs, n_bands, k):
    """Brute force with dictionaries."""
    r = n_sigs // n_bands
    chunk = lambda sig, i: tuple(sorted(sig[i * r:(i + 1) * r]))
    bucket = {}
    for rel_id, (_, sig) in sorted(labelled.items()):
        for i in range(n_bands):
            bucket[i, chunk(sig, i)] = rel_id
    out = {}
    for q, sig in queries.items():
        met = {bucket[i, chunk(sig, i)] for i in range(n_bands) if (i, chunk(sig, i)) in bucket}
        scored = sorted((-sum(x == y for x, y in zip(sig, labelled[c][1])) / n_sigs, c) for c in met)[:k]
        votes, weight = Counter(), defaultdict(float)
        for s, c in scored:
            votes[labelled[c][0]] += 1
            weight[labelled[c][0]] -= s
        if votes:
            out[q] = min(votes, key=lambda t: (-votes[t], -round(weight[t], 9), t))
    return out


def test_knn_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(60)}" for _ in range(12)] for _ in range(12)]
    noisy = lambda b: [w if rnd.random() > 0.15 else f"w{rnd.randrange(60)}" for w in b]
    train = [(i, f"L{i % 3}", noisy(base[i % 12])) for i in range(150)]
    ask = [(1000 + i, noisy(base[i % 12])) for i in range(60)]
    df = spark.createDataFrame(train, "rel_id long, rel_type string, shingles array<string>")
    queries = spark.createDataFrame(ask, "qid long, shingles array<string>")
    for n_sigs, n_bands, k in ((60, 20, 5), (40, 20, 1)):
        index = cl.build_lsh_index(df, n_sigs, n_bands)
        got = {r.qid: r.rel_type for r in cl.classify_features(queries, index, k).collect()}
        sigs = {r.rel_id: (r.rel_type, r.sig) for r in index.labelled.collect()}
        asked = {
            r.qid: r.sig
            for r in nb.signatures(queries.withColumn("rel_id", F.col("qid")).withColumn("rel_type", F.lit("")), n_sigs, ["qid"]).collect()
        }
        want = plain_knn(sigs, asked, n_sigs, n_bands, k)
        assert len(want) > 30 and got == {q: want.get(q, "None") for q, _ in ask}


def test_copies_share_one_lookup(spark):
    bag = spark.createDataFrame([(i, ["a", "b"] if i % 3 else ["c", str(i)]) for i in range(300)], "q long, shingles array<string>")
    assert nb.distinct_bags(nb.with_bag(bag, "shingles"), 8).count() == 101


def test_sweep_agrees_with_single_runs(spark, sf):
    from pairlens.session import materialise
    from pairlens.sources import training as tr

    cat, kb = fx.catalogue(spark), fx.kb(spark, sf)
    extra = "Once <PER>Customer 1</PER> founded <ORG>Firm 7 Inc.</ORG> and Customer 1 left Firm 7 Inc. soon ."
    sentences = materialise(fx.sentences(spark, sf).select("sent_id", "text").union(spark.createDataFrame([(-1, extra)], "sent_id long, text string")), "s")
    stats = ev.corpus_statistics(sentences, cat, fx.types())
    features, bad = cl.training_features(tr.parse_training(fx.run(spark, sf, fx.LABELLED_LINES)))
    # A label outside the catalogue counts as in single runs.
    label = F.when(F.col("rel_type") == "owns", "outside").otherwise(F.col("rel_type"))
    features = materialise(features.withColumn("rel_type", label), "f")
    assert bad.count() == 0 and features.select("shingles").distinct().count() > 300
    names = ["rel_type", "s", "a", "b", "c_pairs", "d_pairs", "precision", "recall", "f1"]
    swept = sw.parameter_sweep(features, *cl.context_features(sentences), kb, stats, cat, [40, 80], [20, 40], [1, 5]).collect()
    assert len({(r.sigs, r.bands, r.k, r.s, r.rel_type) for r in swept}) > 20 and any(r.rel_type == "outside" for r in swept)
    for sigs, bands, k in ((40, 20, 1), (80, 20, 5), (80, 40, 5)):
        rows = materialise(cl.classify_mentions(sentences, cl.build_lsh_index(features, sigs, bands), k), "c")
        done = bs.evaluate_classified(rows, kb, stats, cat)
        want = done.metrics.select("rel_type", "s", "a", "b", "precision", "recall", "f1").filter("s > 0")
        want = want.join(done.sizes.select("rel_type", "c_pairs", "d_pairs"), "rel_type")
        want = sorted(tuple(r) for r in want.select(*names).collect())
        got = sorted(tuple(r[n] for n in names) for r in swept if (r.sigs, r.bands, r.k) == (sigs, bands, k))
        assert len(got) >= 4 and [g[:6] for g in got] == [w[:6] for w in want]
        assert [g[6:] for g in got] == [pytest.approx(w[6:]) for w in want]


def test_grid():
    good, bad = sw.split_grid()
    assert len(good) == 22 and len(bad) == 8 and len(good) * len(sw.NEIGHBOURS) == 88
