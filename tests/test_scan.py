"""Batch kernels against the word rules as expressions, and the index against rows that share a bag."""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.functions import phrases as ph
from pairlens.functions import scan
from pairlens.functions import tagging as tg
from pairlens.functions import text as tx
from pairlens.operators import mentions as mn
from pairlens.operators import neighbours as nb
from pairlens.plans import classify as cl

ODD = [
    None, "", "  \n ", "Acme Inc. bought Foo, and left.", "They can't CANNOT gonna.", 'He said "go" (now)."', "x.\r\n", "x.\u0085", "x. ", "a.b.)", "1,000 at 10:30:x",
    "wait... what -- no", "'tis d'ye mor'n we''re 'S ", "a\x0bb\x1cc d", "Ünï “q” İſ K.", "end. ", "St. X ; [y] {z}", "𝒳y's.",
]


def test_tokens_equal_the_expressions(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, t string")
    want = {r.id: r.x or [] for r in frame.select("id", tx.tokenize(F.col("t")).alias("x")).collect()}
    got = scan.token_lists(pa.array(ODD, pa.string()))
    assert {i: own for i, own in enumerate(got)} == want


def test_evidence_adds_up_however_often_a_task_gives_it_out():
    texts = ["In May <ORG>Acme</ORG> bought <ORG>Foo</ORG> near <LOC>Paris</LOC> .", "<ORG>Acme</ORG> , <ORG>Foo</ORG>", None, "none"] * 3

    def counted(summed):
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2], pa.string())], ["text"]) for i in range(0, len(texts), 2)]
        out = Counter()
        for batch in scan.evidence_rows(2, 1, 6, None, summed)(iter(batches)):
            for r in (r for own in batch.to_pylist() for r in own["x"]):
                n, near = r.pop("n"), r.pop("n_near")
                out[str(r), "n"] += n
                out[str(r), "near"] += near
        return out

    few, many = counted(1), counted(1000)
    assert few == many and sum(v for (k, c), v in many.items() if c == "n" and "mention" in k) == 6


def test_places_of_mentions_cut_their_contexts():
    text = "<ORG>Acme Inc.</ORG> sued Foo while Acme Inc. bought <ORG>Foo</ORG> for 1 dollar ."
    own = scan.mention_kernel(2, 1, 6, None)(pa.array([text, "x"])).to_pylist()
    tokens = scan.token_lists(scan.strip_tags(pa.array([text])))[0]
    assert own[1] == [] and len(own[0]) == 2
    assert all(tokens[m["end1"] : m["start2"]] == m["bet"] and m["gap"] == m["start2"] - m["start1"] for m in own[0])


def test_phrases_of_long_texts_equal_the_automaton(spark):
    words = "he was founded by John , has an atomic weight of 12 and quickly runs up to the old town v4 bought , sold in".split()
    rows = [(i, [words[(i * 7 + j * j) % len(words)] for j in range(40 * i)]) for i in range(8)]
    tagged = spark.createDataFrame(rows, "id int, toks array<string>").select("id", tg.tag_tokens(F.col("toks")).alias("g"))
    numbers = F.transform(ph.phrase_numbers(F.col("g")), lambda n: F.when(n > 0, "1").otherwise("0"))
    assert all(r.a == r.b for r in tagged.select(numbers.alias("a"), ph.in_phrase(F.col("g")).alias("b")).collect())


def test_index_holds_one_row_of_each_bag(spark):
    rows = [(i, "a" if i % 3 else "b", ["p", "q"]) for i in range(50)] + [(100, "c", ["p"]), (100, "c", ["r", "s"]), (None, "d", ["t"])]
    features = spark.createDataFrame(rows, "rel_id long, rel_type string, shingles array<string>")
    index = cl.build_lsh_index(features, 20, 5)
    every = nb.one_per_id(nb.signatures(features, 20))
    want = {tuple(r) for r in nb.last_writers(nb.band_rows(every, 20, 5, ["rel_id"])).collect()}
    assert {tuple(r) for r in index.buckets.collect()} == want
    assert sorted(str(r.rel_id) for r in index.labelled.collect()) == ["100", "49", "None"]


def test_batches_equal_the_expressions_on_odd_texts(spark):
    """Names that repeat untagged, overlap, differ in blanks or stand at an end, against the array expressions."""
    texts = [
        "<ORG>Acme</ORG> and Acme Inc. bought <ORG>Acme Inc.</ORG> from <PER>Jo</ORG> <PER>Jo</PER>", "<ORG>Acme  Inc</ORG> sold <PER>Acme Inc</PER> to <ORG>Acme Inc</ORG>",
        "<ORG> </ORG> met <PER>Jo</PER> , \"so\" <LOC>U.S.</LOC> can't <ORG>Acme</ORG>", "<ORG>A</ORG> a <ORG>B</ORG> b <ORG>A</ORG> c d <ORG>C</ORG> won <ORG>B</ORG> .",
        "<ORG>A</ORG>", None, "", "<ORG>A</ORG> of <ORG>B</ORG>", "x</b> <ORG>B</ORG> hired <PER>B</PER> <ORG>B</ORG>",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    text = F.col("text")
    tokens = tx.tokenize(tx.strip_tags(text))
    pairs = F.filter(mn.neighbour_pairs(tx.locate_entities(tx.distinct_entities(text), F.col("tokens"))), lambda p: mn.pair_is_valid(p))
    rows = frame.filter(tx.has_two_entities(text)).select("id", "text", tokens.alias("tokens")).select("id", "tokens", F.explode(pairs).alias("p"))
    rows = rows.select("id", mn.with_contexts(F.col("p"), F.col("tokens"), 2).alias("m")).filter(tx.is_relational(F.col("m.bet")))
    want = sorted((r.id, r.m.e1, r.m.e1_type, r.m.e2, r.m.e2_type, r.m.bef, r.m.bet, r.m.aft, r.m.gap) for r in rows.collect())
    names = ("e1", "e1_type", "e2", "e2_type", "bef", "bet", "aft", "gap")
    own = scan.mention_kernel(2, 1, 6, None)(pa.array(texts, pa.string())).to_pylist()
    assert sorted((i, *[m[c] for c in names]) for i, found in enumerate(own) for m in found) == want and len(want) == 4
    hits = scan.near_kernel(1, 20)(pa.array(texts[3:4], pa.string())).to_pylist()[0]
    phrases = {(h["e1"], h["e2"]): h["phrase"] for h in hits}
    assert phrases["A", "C"] == "c d" and phrases["A", "B"] == "c d < ORG > C < /ORG > won" and phrases["B", "A"] is None


def test_a_scan_takes_no_loop_per_sentence():
    """A batch costs array operations for all its texts, so Python calls do not grow with them."""
    import sys

    def calls(n: int) -> int:
        texts = pa.array([f"In <ORG>Firm {i}</ORG> bought <PER>Jo {i}</PER> in May ." for i in range(n)], pa.string())
        batch, count = scan.Batch(texts), 0

        def seen(frame, event, arg):
            nonlocal count
            count += event == "call"

        sys.setprofile(seen)
        try:
            batch.near(1, 6)
            found = batch.mentions(1, 6, None)
            found.contexts(2)
        finally:
            sys.setprofile(None)
        assert len(found.sent) == n
        return count

    few, many = calls(100), calls(1100)
    assert many - few < 6 * 1000


def test_places_of_given_pairs_against_a_plain_search():
    import random

    rnd = random.Random(4)
    words = ["a", "b", "a b", "Inc.", "Firm 3 Inc.", "x y", "can't", "", ".", "b b"]
    for least, most, window, forward in [(1, 6, 3, True), (1, 6, 3, False), (0, 2, 1, False), (2, 3, 0, True)]:
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(20))) if rnd.random() > 0.1 else None for _ in range(60)]
        ones, twos = ([rnd.choice([*words, None]) for _ in texts] for _ in range(2))
        got = scan.known_pair_kernel(window, least, most, forward)(*[pa.array(x, pa.string()) for x in (texts, ones, twos)]).to_pylist()
        want = []
        for text, one, two in zip(texts, ones, twos):
            tokens = scan.tokens_of_text(text or "")
            own1, own2 = (scan.name_parts([n])[n] if n else [] for n in (one, two))
            at1, at2 = ([i for i in range(len(tokens)) if own and tokens[i : i + len(own)] == own] for own in (own1, own2))
            pairs = [(i, j) for i in at1 for j in at2 if least <= (j - i if forward else abs(j - i)) <= most]
            want.append([
                {"e1": one, "e2": two, "bef": tokens[max(i - window, 0) : i], "bet": tokens[i + len(own1) : max(j, i + len(own1))],
                 "aft": tokens[j + len(own2) : j + len(own2) + window], "gap": j - i} for i, j in pairs
            ])
        assert got == want and sum(map(len, got)) > 3
    assert scan.known_pair_kernel(3, 1, 6, True)(*[pa.array([], pa.string())] * 3).to_pylist() == []
