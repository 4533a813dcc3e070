import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import minhash as mh
from pairlens.functions import phrases as ph
from pairlens.functions import shingles as sh
from pairlens.functions import tagging as tg
from pairlens.operators import neighbours as nb


def tagged(spark, text):
    """``tok/TAG/lemma`` words -> one-row frame with a tagged array ``g``."""
    toks = [tuple(w.split("/")) for w in text.split()]
    toks = [t if len(t) == 3 else (t[0], t[1], t[0].lower()) for t in toks]
    return spark.createDataFrame([(toks,)], f"g {tg.TAGGED}")


def phrase(spark, text):
    return " ".join(t.tok for t in tagged(spark, text).select(ph.relation_phrase(F.col("g")).alias("p")).first().p)


def passive(spark, text):
    return tagged(spark, text).select(ph.is_passive(F.col("g")).alias("p")).first().p


def test_relation_phrase(spark):
    assert phrase(spark, "he/PRP was/VBD founded/VBN by/IN John/NNP") == "was founded by"
    assert phrase(spark, "has/VBZ an/DT atomic/JJ weight/NN of/IN 12/CD") == "has an atomic weight of"
    assert phrase(spark, "the/DT head/NN of/IN") == ""
    # The token that ends a phrase is used up, even when it is a verb.
    assert phrase(spark, "v1/VB v2/VB r/RB n/NN x/CC a/IN v3/VBZ n/NN v4/VB a/IN") == "v1 v2 r n v3 n"


def test_universal_phrases_stay_apart(spark):
    rows = tagged(spark, "a/VB x/CC b/VBD c/NN in/IN").select(ph.relation_phrases_universal(F.col("g")).alias("p")).first().p
    assert [[t.tok for t in p] for p in rows] == [["a"], ["b", "c", "in"]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("was/VBD/be founded/VBN/found by/IN", True),
        ("was/VBD/be founded/VBN/found yesterday/NN by/IN", True),
        ("was/VBD/be quickly/RB founded/VBN/found by/IN", True),
        ("founded/VBN/found by/IN", True),
        ("founded/VBN/found in/IN", False),
        ("has/VBZ/have founded/VBN/found early/RB by/IN", False),
        ("wants/VBZ/want bought/VBD/buy by/IN", True),
        ("by/IN", False),
        ("head/NN owned/VBN/own by/IN", False),
    ],
)
def test_passive(spark, text, expected):
    assert passive(spark, text) is expected


def bag(spark, column, text):
    return tagged(spark, text).select(column.alias("x")).first().x


def test_shingles(spark):
    g = F.col("g")
    text = "is/VBZ/be the/DT owner/NN of/IN running/VBG/run to/TO has/VBZ/have"
    assert bag(spark, sh.verb_shingles(g, "BET"), text) == ["running_VBG_BET"]
    assert bag(spark, sh.preposition_shingles(g), text) == ["of_PREP", "to_PREP"]
    assert bag(spark, sh.noun_shingles(g), text) == ["owner_NN_BET"]
    assert bag(spark, sh.phrase_shingles(g), "was/VBD/be bought/VBN/buy by/IN") == ["was_bought_by_RVB_PASSIVE", "be_buy_by_RVB_NORM"]
    assert bag(spark, sh.phrase_shingles(g), "the/DT") == []


def test_char_ngrams(spark):
    df = spark.createDataFrame([("is in",), ("abc",), ("",), ("a\nüé€x",)], "t string")
    got = [r.x for r in df.select(sh.char_ngrams(F.col("t"), "AFT").alias("x")).collect()]
    assert got == [["is_i_AFT", "s_in_AFT"], [], [], ["a\nüé_AFT", "\nüé€_AFT", "üé€x_AFT"]]


def signatures(spark, bags, n):
    df = spark.createDataFrame([(i, "r", b) for i, b in enumerate(bags)], "rel_id long, rel_type string, shingles array<string>")
    return [r.sig for r in nb.signatures(df, n).orderBy("rel_id").collect()]


def test_signature_is_prefix_stable_and_order_free(spark):
    bags = [["a", "b", "c"], ["c", "a", "b", "a", ""], [], ["x"]]
    short, long = signatures(spark, bags, 20), signatures(spark, bags, 60)
    assert [s[:20] for s in long] == short
    assert short[0] == short[1] != short[3]
    assert short[2] == [mh.PRIME] * 20


def test_signature_matches_definition(spark):
    import hashlib

    words = ["alpha", "beta", "gamma"]
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    want = [min((a * h + b) % mh.PRIME for h in hashes) for a, b in mh.family(50)]
    assert signatures(spark, [words], 50)[0] == want


def test_positions_are_worked_out_once_for_each_different_hash(monkeypatch):
    import pyarrow as pa

    rows = [[5, 9, 2**32 - 1], [], [9, 5], [7] * 3] * 50
    sizes = pa.array([len(r) for r in rows])
    worked, fold = [], mh._fold
    monkeypatch.setattr(mh, "_fold", lambda x: worked.append(len(x)) or fold(x))
    got = mh._kernel(4)(pa.array(rows, pa.list_(pa.int64())), sizes).to_pylist()
    assert got == [[min([(a * h + b) % mh.PRIME for h in r], default=mh.PRIME) for a, b in mh.family(4)] for r in rows]
    assert worked == [4] * 4


def test_similarity_estimates_jaccard(spark):
    left, right = [f"s{i}" for i in range(0, 80)], [f"s{i}" for i in range(20, 100)]
    a, b = signatures(spark, [left, right], 600)
    share = np.mean(np.array(a) == np.array(b))
    assert abs(share - 60 / 100) < 4 * np.sqrt(0.6 * 0.4 / 600)


def test_bands_match_as_multisets_and_must_divide(spark):
    df = spark.createDataFrame([([3, 1, 2, 9],), ([1, 2, 3, 9],), ([1, 2, 4, 9],)], "sig array<int>")
    keys = [[(b.band, b.key) for b in r.k] for r in df.select(mh.band_keys(F.col("sig"), 4, 2).alias("k")).collect()]
    assert [k[0][0] for k in keys] == [0, 0, 0] and keys[0][0] != keys[1][0]
    whole = [r.k[0].key for r in df.select(mh.band_keys(F.col("sig"), 4, 1).alias("k")).collect()]
    assert whole[0] == whole[1] != whole[2]
    with pytest.raises(ValueError):
        mh.rows_per_band(100, 75)


def test_lexicon_overrides_rules(spark):
    rows = spark.createDataFrame([(1, ["Acme", "zorbed", "Foo"]), (2, [])], "id int, toks array<string>")
    lexicon = spark.createDataFrame([("zorbed", "VBD", "zorb")], "token string, tag string, lemma string")
    out = {r.id: [(t.tok, t.tag, t.lemma) for t in r.tagged] for r in tg.tag_with_lexicon(rows, "id", "toks", lexicon).collect()}
    assert out[1] == [("Acme", "NNP", "acme"), ("zorbed", "VBD", "zorb"), ("Foo", "NNP", "foo")] and out[2] == []


def test_third_persons_and_ied(spark):
    words = ["owns", "acquires", "Studies", "studied", "buys", "boxes", "reaches", "offices"]
    frame = spark.createDataFrame([(words,)], "t array<string>").select(tg.tag_tokens(F.col("t")).alias("t"))
    got = {t.tok: (t.tag, t.lemma) for t in frame.first().t}
    assert got == {
        "owns": ("VBZ", "own"), "acquires": ("VBZ", "acquire"), "Studies": ("VBZ", "study"), "studied": ("VBN", "study"),
        "buys": ("VBZ", "buy"), "boxes": ("NNS", "box"), "reaches": ("NNS", "reach"), "offices": ("NNS", "office"),
    }
