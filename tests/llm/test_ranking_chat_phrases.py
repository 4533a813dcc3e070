"""Chat logs, ranked search and phrase mining against plain Python."""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import ball_tree_search as bt
from pairlens.llm import chat_events as ce
from pairlens.llm import phrase_tries as pt

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# --- chat

TURNS = [
    (1, 0, "system", "Be [INST] brief <\\s> <s>"),
    (1, 1, "user", "x" * 1203),
    (1, 2, "assistant", "</s>[INST] \\ ok [/INST]"),
    (1, 2, "assistant", "</s>[INST] \\ ok [/INST]"),
    (1, None, "to[ROLE] ol ", " spaced \n text "),
    (2, 5, None, None),
    (2, 6, "assistant", ""),
    (3, 0, "assistant", "日本 \U0001f600 [x] <"),
    (None, 0, "user", "alone"),
    (None, 0, "user", "alone"),
]


def chat_table(spark, rows=TURNS):
    rows = [(*r, "clash", "m", 1) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string, events string, __row int").repartition(3)


def brute_turns(rows):
    held = {}
    for i, (conv, turn, role, text) in enumerate(rows):
        key = (conv, i if conv is None else None)
        held.setdefault(key, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {key: [(role, text) for _, role, text in sorted(turns)] for key, turns in held.items()}


def test_chats_read_back_as_they_were(spark):
    rendered = ce.chats(chat_table(spark))
    got = sorted((r["conv_id"] or 0, [(t["role"], t["text"]) for t in r["turns"]]) for r in rendered.select("conv_id", ce.parsed(F.col("formatted")).alias("turns")).collect())
    assert got == sorted((key[0] or 0, turns) for key, turns in brute_turns(TURNS).items())
    for row in rendered.collect():
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
        texts = [s["text"] for s in row["segments"] if s["loss"]]
        assert not any(re.search(rf"[\[<](?:{ce.TAILS})", t) for t in texts)
    digests = {(r["conv_id"], r["n_turns"]): r for r in ce.read_back(rendered).collect()}
    loss = "".join(t for role, t in brute_turns(TURNS)[(1, None)] if role == "assistant")
    assert digests[(1, 5)]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert digests[(1, 5)]["loss_chars"] == len(loss)
    assert ce.chats(chat_table(spark).filter("false")).count() == 0


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(4)
    parts = ["[", "<", "\\", "/", "s>", "INST]", "ROLE]", "[/INST]", "</s>", "<s>", " ", "a", "[TURN]", "SYS]"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ce.escape(F.col("t")).alias("e"))
    for row in frame.select("t", "e", ce.unescape(F.col("e")).alias("back")).collect():
        assert row["back"] == row["t"]
        assert not re.search(rf"[\[<](?:{ce.TAILS})", row["e"])
        if not re.search(rf"[\[<]\\*(?:{ce.TAILS})", row["t"]):
            assert row["e"] == row["t"]


def test_log_is_folded_by_message(spark):
    events = [
        (1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, "helo"), (1, 2, 2, "open", "assistant", None), (1, 2, 3, "delta", None, "wrong"),
        (1, 1, 4, "edit", None, "hello"), (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "ri"), (1, 2, 7, "delta", None, "ght"),
        (1, 2, 7, "delta", None, "ght"), (1, 1, 8, "delta", None, "!"), (2, 1, 0, "delta", None, "no role"), (2, 2, 0, "open", "user", None), (2, 2, 1, "delta", None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, message long, seq int, kind string, role string, text string")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in ce.messages(log.repartition(4)).collect()}
    assert got == {(1, 1): ("user", "hello!"), (1, 2): ("assistant", "right"), (2, 1): ("", "no role"), (2, 2): ("user", "")}


# --- ranked search


def brute_search(docs, items, top=10):
    cut = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    df = Counter(t for _, terms in cut for t in set(terms))
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for doc, terms in cut:
            if terms:
                m, tf = 100 - 90 + (90 * len(terms) * n_docs) // n_terms, Counter(terms)
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked & tf.keys())
                if score > 0:
                    scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def search_tables(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É1", "日本", "Wx"]
    docs = [(i, " ".join(rng.choice(words[: 5 + i % 58]) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    docs += [(1, docs[1][1]), (1, docs[1][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "-- ++"), (903, "w1 " * 30000), (899, docs[7][1]), (None, docs[3][1])]
    items = [(0, "W1 w2 w1, w60"), (1, None), (1, "none-such"), (2, docs[7][1]), (3, docs[3][1]), (3, docs[3][1]), (None, "É1 é1 日本 wX")]
    return docs, items


@pytest.mark.parametrize("size", [2048, 50])
def test_search_equals_brute_force(spark, size):
    docs, items = search_tables(spark)
    frame = spark.createDataFrame([(i, t, "score", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")
    blocks = list(bt.query_blocks(queries, 2, 30))
    assert len(blocks) > 2 and max(len(b.ids) for b in blocks) <= 2
    found = []
    for block in blocks:
        part = bt.best_of_tasks(frame, block, block=size).collect()
        assert len(part) <= 30 * len(block.ids)
        found += [(block.ids[r["query"]], r["doc_id"], r["score"]) for r in part]
    want = brute_search(docs, items)
    got = [tuple(r) for r in bt.search(frame, queries).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(i, d, s) for i, _, d, s in want} <= set(found)
    assert bt.search(frame.filter("false"), queries).count() == 0
    assert bt.search(frame, queries.filter("false")).count() == 0


def test_bounds_hold_in_every_tree():
    rng = np.random.default_rng(2)
    for leaf in (1, 4):
        sizes = rng.integers(1, 9, 120)
        columns = np.concatenate([np.sort(rng.choice(50, n, False)) for n in sizes])
        values = rng.integers(1, 1_000_000, len(columns))
        tree = bt.Tree(list(range(120)), np.concatenate([[0], np.cumsum(sizes)]), columns, values, 50, leaf)
        dense = np.zeros((120, 50))
        for i in range(120):
            own = slice(tree.starts[i], tree.starts[i + 1])
            dense[i, tree.columns[own]] = tree.values[own]

        def members(at, tree=tree):
            if tree.children[at] is None:
                return list(range(tree.firsts[tree.leaf_of[at]], tree.firsts[tree.leaf_of[at] + 1]))
            return [m for c in tree.children[at] for m in members(c)]

        assert sorted(members(0)) == list(range(120))
        for at in range(len(tree.children)):
            far = np.linalg.norm(dense[members(at)] - tree.centroids[at], axis=1)
            assert (far <= tree.radii[at] * (1 + 1e-9)).all()


def test_search_leaves_subtrees_out():
    rng = np.random.default_rng(3)
    columns = np.concatenate([np.arange(5) + 5 * (i // 64) for i in range(640)])
    values = rng.integers(1000, 1100, len(columns))
    tree = bt.Tree(list(range(640)), np.arange(0, 3205, 5), columns, values, 50)
    terms, weights = np.arange(5), np.full(5, 10, np.int64)
    dense = np.zeros(50, np.int64)
    dense[terms] = weights
    assert tree.search(terms, weights, [], 10, dense) < 20  # of 64 leaves


# --- phrases


def brute_phrases(docs, least, top=2000):
    counts, totals = {}, Counter()
    for text, lang in docs:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        rows = []
        many = {p: f for p, f in own.items() if f >= least and len(p) > 1}
        longer = Counter()
        for p, f in many.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], f)
        for p, a in many.items():
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_table(spark):
    rng = random.Random(9)
    words = ["the", "THE", "new", "york", "city", "of", "É", "日本", "a\x00b", "x\x1cy", "nor'", "\xa0"]
    docs = []
    for i in range(300):
        text = "".join(rng.choice(words[: 3 + i % 10]) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r", ";x "]) for _ in range(rng.randint(1, 60)))
        docs.append((text, ["en", "de", None, "und"][i % 4]))
    docs += [docs[0]] * 40 + [(None, "en"), ("", "fr"), ("new york city of " * 3000, "fr"), ("...", None)]
    return docs, spark.createDataFrame([(t, lang, "n", 3) for t, lang in docs], "text string, lang string, phrase string, n int").repartition(3)


@pytest.mark.parametrize("bounds", [{}, {"states": 10, "vocabulary": 3}])
def test_phrases_equal_brute_force(spark, bounds):
    docs, frame = phrase_table(spark)
    got = sorted(tuple(r) for r in pt.collocations(frame, 12, **bounds).collect())
    assert got == brute_phrases(docs, 12)
    assert len(got) > 50
    if not bounds:
        assert sorted(tuple(r) for r in pt.collocations(frame, 12, top=3).collect()) == [r for r in got if r[1] <= 3]
        assert pt.collocations(frame.filter("false")).count() == 0


def test_double_array_finds_its_phrases_and_no_others():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3):
        phrases = np.unique(rng.integers(0, 40, (300, depth)) * 7, axis=0)
        rng.shuffle(phrases)
        trie = pt.DoubleArray(phrases)
        ids = rng.integers(0, 42, 20000) * 7 - 7 * (rng.random(20000) < 0.1)
        places = {tuple(p): i for i, p in enumerate(phrases.tolist())}
        want = [places.get(tuple(ids[i : i + depth].tolist()), -1) for i in range(len(ids))]
        assert trie.advance(ids).tolist() == want
    assert pt.DoubleArray(np.zeros((0, 2), np.int64)).advance(np.arange(5)).tolist() == [-1] * 5


def test_candidates_are_shuffled_as_one_number(spark, monkeypatch):
    """The sum over candidates is the largest shuffle: its rows are a number and a count."""
    frame = spark.createDataFrame([("en", "a b c a b c a b d")] * 6, "lang string, text string")
    plans, kept = {}, pt.materialise

    def seen(rows, name):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return kept(rows, name)

    monkeypatch.setattr(pt, "materialise", seen)
    found, _ = pt.levels(frame, 6, 3)
    assert sorted((r.phrase, r.f) for r in found[2].collect()) == [("a b c", 12), ("a b d", 6), ("b c a", 12), ("c a b", 12)]
    for k in (2, 3):
        assert "hashpartitioning(key#" in plans[f"phrase-counts-{k}"] and "hashpartitioning(prefix#" not in plans[f"phrase-counts-{k}"]
