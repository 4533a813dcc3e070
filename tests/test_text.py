from pyspark.sql import functions as F

from pairlens.functions import text as tx
from pairlens.operators import mentions as mn


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def tokens(spark, text):
    return frame(spark, text).select(tx.tokenize(F.col("text")).alias("t")).first().t


def test_treebank_rules(spark):
    assert tokens(spark, "Acme Inc. bought Foo, and left.") == ["Acme", "Inc.", "bought", "Foo", ",", "and", "left", "."]
    assert tokens(spark, "They can't cannot.") == ["They", "ca", "n't", "can", "not", "."]
    assert tokens(spark, 'He said "go" (now)') == ["He", "said", "``", "go", "''", "(", "now", ")"]
    assert tokens(spark, "Bob's firm cost 1,000 at 10:30") == ["Bob", "'s", "firm", "cost", "1,000", "at", "10:30"]
    assert tokens(spark, "wait... what -- no") == ["wait", "...", "what", "--", "no"]
    assert tokens(spark, "") == [] and tokens(spark, "  \n ") == []


def pairs(spark, text, **kw):
    rows = mn.extract_mentions(frame(spark, text), **kw).collect()
    return [(r.e1, r.e2, " ".join(r.bef), " ".join(r.bet), " ".join(r.aft)) for r in rows]


def test_contexts_and_neighbours(spark):
    text = "In May <ORG>Acme</ORG> bought <ORG>Foo</ORG> near <LOC>Paris</LOC> for cash ."
    assert pairs(spark, text) == [
        ("Acme", "Foo", "In May", "bought", "near Paris"),
        ("Foo", "Paris", "Acme bought", "near", "for cash"),
    ]
    assert pairs(spark, text, types=[("ORG", "LOC")]) == [("Foo", "Paris", "Acme bought", "near", "for cash")]


def test_glued_name_found_in_mid_sentence_only(spark):
    assert pairs(spark, "<ORG>Acme Inc.</ORG> owns <ORG>Foo</ORG> .") == [("Acme Inc.", "Foo", "", "owns", ".")]
    # At the end of the sentence the period is a token of its own, so the glued name is not there.
    assert pairs(spark, "<ORG>Foo</ORG> owns <ORG>Acme Inc.</ORG>") == []


def test_untagged_repeats_are_mentions_too(spark):
    text = "<ORG>Acme</ORG> sued Foo while Acme bought <ORG>Foo</ORG> ."
    # (Foo, Acme) lies between, with a stop word only.
    assert [(p[0], p[1], p[3]) for p in pairs(spark, text)] == [("Acme", "Foo", "sued"), ("Acme", "Foo", "bought")]
    blocked = "<ORG>Acme</ORG> saw Bob beat <ORG>Foo</ORG> with <PER>Bob</PER> ."
    assert ("Acme", "Foo") not in [(p[0], p[1]) for p in pairs(spark, blocked)]


def test_stop_words_and_distance(spark):
    assert pairs(spark, "<ORG>A</ORG> , and the <ORG>B</ORG> x") == []
    assert pairs(spark, "<ORG>A</ORG> <ORG>B</ORG> x") == []
    assert len(pairs(spark, "<ORG>A</ORG> one two three four five <ORG>B</ORG>")) == 1
    assert pairs(spark, "<ORG>A</ORG> one two three four five six <ORG>B</ORG>") == []
    # The distance runs from start to start, so a longer first name leaves less room.
    assert pairs(spark, "<ORG>A B</ORG> one two three four five <ORG>C</ORG>") == []


def test_same_name_is_no_pair(spark):
    assert pairs(spark, "<ORG>A</ORG> met <ORG>A</ORG> joined <ORG>B</ORG>") == [("A", "B", "A met", "joined", "")]


def test_longest_name_wins_at_one_position(spark):
    text = "<LOC>New York</LOC> <ORG>New York Times</ORG> praised <PER>Bob</PER> ."
    found = frame(spark, text).select(
        tx.locate_entities(tx.distinct_entities(F.col("text")), tx.tokenize(tx.strip_tags(F.col("text")))).alias("x")
    ).first().x
    assert [(e.pos, e.len, e.s) for e in found] == [(0, 2, "New York"), (2, 3, "New York Times"), (6, 1, "Bob")]


def test_mismatched_closing_tag_takes_opening_type(spark):
    rows = frame(spark, "<ORG>A</LOC> <per>b</per>").select(F.explode(tx.extract_entities(F.col("text"))).alias("e")).collect()
    assert [(r.e.s, r.e.ty) for r in rows] == [("A", "ORG")]


def test_partitioning_does_not_matter(spark, sf):
    from workload import fixtures as fx

    rows = fx.sentences(spark, sf)
    one = sorted(map(str, mn.distinct_mentions(mn.extract_mentions(rows.coalesce(1))).collect()))
    many = sorted(map(str, mn.distinct_mentions(mn.extract_mentions(rows.repartition(16))).collect()))
    assert one == many
