"""Keys, null bags, repeated ids and unknown relations: nothing is lost or mixed up."""
from __future__ import annotations

import random

from pairlens.functions import minhash as mh
from pairlens.operators import neighbours as nb
from pairlens.plans import classify as cl
from pairlens.plans import evaluate as ev
from pairlens.operators import support as sp
from pairlens.plans import sweep as sw
from pairlens.sources import catalogue as cat
from pairlens.sources import training as tr


def test_borders_between_arrays_are_part_of_the_key(spark):
    rows = [(["x"], ["bought"], ["in"]), ([], ["x", "bought"], ["in"]), (["x", "bought"], ["in"], []), (["x"], ["bought"], ["in"])]
    frame = spark.createDataFrame(rows, "bef array<string>, bet array<string>, aft array<string>")
    bags = [r["bag"] for r in nb.with_bag(frame, "bef", "bet", "aft").collect()]
    assert len(set(bags)) == 3 and bags[0] == bags[3]


def test_a_sentence_has_the_same_label_alone_and_in_a_batch(spark):
    def tagged(words):
        return words.replace("Ann", "<PER>Ann</PER>").replace("Foo", "<ORG>Foo</ORG>")

    training = [(1, "L1", "Ann", "Foo", tagged("Ann works for Foo today .")), (2, "L2", "Ann", "Foo", tagged("Ann works for today Foo ."))]
    frame = spark.createDataFrame(training, "rel_id long, rel_type string, e1 string, e2 string, sentence string")
    features, _ = cl.training_features(frame)
    index = cl.build_lsh_index(features)
    texts = [t[-1] for t in training]

    def labels(own):
        found = cl.classify_mentions(spark.createDataFrame([(t,) for t in own], "text string"), index, k=1)
        return {r["sentence"]: r["rel_type"] for r in found.collect()}

    assert labels(texts) == {t: labels([t])[t] for t in texts}


def test_null_bags_and_repeated_ids(spark):
    bags = [(1, "a", ["p", "q"]), (1, "b", ["p", "q"]), (2, "c", None)]
    features = spark.createDataFrame(bags, "rel_id long, rel_type string, shingles array<string>")
    index = cl.build_lsh_index(features, 20, 5)
    assert sorted(r["rel_id"] for r in index.labelled.collect()) == [1, 2]
    assert [tuple(r) for r in nb.repeated_ids(features).collect()] == [(1, 2)]
    asked = spark.createDataFrame([(10, ["p", "q"]), (11, None)], "query_id long, shingles array<string>")
    got = {r["query_id"]: (r["rel_type"], r["votes"]) for r in cl.classify_features(asked, index, 3).collect()}
    assert got[10] == ("b", 1) and 11 in got


def test_facts_of_unknown_relations_are_not_lost(spark):
    relations = cat.relation_catalogue(spark, ["founder"])
    triples = spark.createDataFrame([("founder", "A", "B", "founded"), ("unheard", "A", "B", "met")], "rel_type string, e1 string, e2 string, bet string")
    counts = spark.createDataFrame([], "e1 string, e1_type string, e2 string, e2_type string, phrase string, hits long")
    got = sp.exact_phrase_verdicts(triples, counts.select(*sp.PAIR, "phrase", "hits"), relations).collect()
    assert {r["rel_type"]: r["supported"] for r in got} == {"founder": False, "unheard": False}


def test_a_training_line_is_made_and_cut_once(spark):
    """Tests on fields and types stay above what makes them: neither the line nor its parts are worked out again for each."""
    made = "concat('id:', id, '\\t', if(id % 2 = 0, 'owns', 'founder'), '\\tA\\tB\\t<ORG>A</ORG> x <LOC>B</LOC>') AS value"
    lines = spark.range(6).selectExpr(made).unionByName(spark.createDataFrame([("# a",), ("",), (None,), ("id:1\tx",)], "value string"))
    training = tr.parse_training(lines)
    keyed, _, bad = cl.training_contexts(training)
    assert keyed.count() == 6 and bad.count() == 0
    typed = training.selectExpr("*").filter("sentence != '' AND e1 != ''")
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("concat(") == 1


def test_type_of_the_first_span_with_the_name(spark):
    rows = [(1, "A", "B", "<ORG>A</ORG> bought <LOC>B</LOC> and <PER>A</PER>"), (2, "A", "C", "<ORG>A</ORG> is C"), (3, None, "B", "<LOC>B</LOC>"), (4, "A", "B", None)]
    frame = spark.createDataFrame([(i, "r", a, b, t) for i, a, b, t in rows], "rel_id long, rel_type string, e1 string, e2 string, sentence string")
    keyed, made, bad = cl.training_contexts(frame)
    assert [r["rel_id"] for r in keyed.collect()] == [1] and sorted(r["rel_id"] for r in bad.collect()) == [2, 3, 4]
    assert {"ORG_ENTITY1", "LOC_ENTITY2"} <= set(made.first()["shingles"])
    # A few contexts with much work each are not left to one task.
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_last_row_of_each_bag_against_plain_python(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["x", "y", None]), rnd.randrange(12)) for _ in range(120)]
    bags = {b: [b * 7 % 5, b] for b in range(12)}
    frame = spark.createDataFrame(rows, "rel_id long, rel_type string, bag int")
    got = nb.last_of_bags(frame, spark.createDataFrame(list(bags.items()), "bag int, sig array<int>")).collect()
    low = lambda v: (v is not None, v or 0) if not isinstance(v, str) else (True, v)
    of_id = {}
    for i, t, b in rows:
        of_id[i] = max(of_id.get(i, (t, b)), (t, b), key=lambda r: ((r[0] is not None, r[0] or ""), bags[r[1]], r[1]))
    last = {}
    for i, (t, b) in of_id.items():
        last[b] = max(last.get(b, (i, t)), (i, t), key=lambda r: (low(r[0]), (r[1] is not None, r[1] or "")))
    assert sorted(map(str, [(r["rel_id"], r["rel_type"], r["sig"]) for r in got])) == sorted(map(str, [(*last[b], bags[b]) for b in last]))


def test_bands_of_equal_width_are_looked_up_once(spark):
    settings, _ = sw.split_grid()
    widths = sw.shared_bands(settings)
    assert widths[4] == 150 and sum(widths.values()) < sum(b for _, b in settings)
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(3) for _ in range(24)]) for i in range(40)]
    signed = spark.createDataFrame(rows, "rel_id long, sig array<int>")
    small = [(12, 6), (24, 12), (24, 6), (24, 1)]
    found = {}
    for r in sw.chunk_rows(signed, small, ["rel_id"]).collect():
        found.setdefault((r["width"], r["band"]), {})[r["rel_id"]] = r["key"]
    assert {w: sum(1 for v, _ in found if v == w) for w in (2, 4, 24)} == {2: 12, 4: 6, 24: 1}
    for (w, i), keys in found.items():
        parts = {n: tuple(sorted(sig[i * w : i * w + w])) for n, sig in rows}
        assert len(set(keys.values())) == len(set(parts.values())) == len({(keys[n], parts[n]) for n in keys})


def test_equal_positions_of_prefixes(spark):
    frame = spark.createDataFrame([([1, 2, 3, 4], [1, 0, 3, 4]), ([5, 5, 5, 5], [5, 6, 7, 8])], "a array<int>, b array<int>")
    assert [r["n"] for r in frame.select(mh.prefix_matches(frame.a, frame.b, [1, 3, 4]).alias("n")).collect()] == [[1, 2, 3], [1, 1, 1]]
