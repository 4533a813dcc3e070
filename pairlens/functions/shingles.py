"""Shingles of a mention: entity types, phrases, verbs, prepositions, nouns and character n-grams."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.columns import let, literal_array
from pairlens.functions.phrases import is_passive, relation_phrase

# Fixed values.
NGRAM_SIZE = 4
AUXILIARIES = ["be", "have"]
VERB_TAGS = ["VB", "VBD", "VBN", "VBP", "VBZ", "VBG"]


def char_ngrams(text: Column, context: str) -> Column:
    """Character 4-grams with ``_`` for a space and the context as suffix; none for shorter text."""
    # One regex pass; cutting by position would walk the string from its start for every gram.
    grams = F.regexp_extract_all(F.translate(text, " ", "_"), F.lit(rf"(?s)(?=(.{{{NGRAM_SIZE}}}))."), F.lit(1))
    return F.transform(grams, lambda g: F.concat(g, F.lit("_" + context)))


def entity_type_shingles(e1_type: Column, e2_type: Column) -> Column:
    return F.array(F.concat(e1_type, F.lit("_ENTITY1")), F.concat(e2_type, F.lit("_ENTITY2")))


def verb_shingles(tagged: Column, context: str) -> Column:
    """``token_TAG_CONTEXT`` of every verb that is no form of be or have."""
    verbs = F.filter(tagged, lambda t: t["tag"].isin(VERB_TAGS) & ~t["lemma"].isin(AUXILIARIES))
    return F.transform(verbs, lambda t: F.concat_ws("_", t["tok"], t["tag"], F.lit(context)))


def preposition_shingles(tagged: Column) -> Column:
    found = F.filter(tagged, lambda t: t["tag"].startswith("IN") | t["tag"].startswith("TO"))
    return F.transform(found, lambda t: F.concat(t["tok"], F.lit("_PREP")))


def noun_shingles(tagged: Column) -> Column:
    return F.transform(F.filter(tagged, lambda t: t["tag"] == "NN"), lambda t: F.concat(t["tok"], F.lit("_NN_BET")))


def phrase_shingles(tagged_bet: Column) -> Column:
    """The relational phrase of BET as written and as lemmas; none without a phrase."""

    def build(phrase: Column) -> Column:
        words = F.array_join(F.transform(phrase, lambda t: t["tok"]), "_")
        lemmas = F.array_join(F.transform(phrase, lambda t: t["lemma"]), "_")
        suffix = F.when(is_passive(phrase), "_RVB_PASSIVE").otherwise("_RVB")
        both = F.array(F.concat(words, suffix), F.concat(lemmas, F.lit("_RVB_NORM")))
        return F.when(F.size(phrase) > 0, both).otherwise(literal_array([]))

    return let(relation_phrase(tagged_bet), build)


def _text(tagged: Column) -> Column:
    return F.array_join(F.transform(tagged, lambda t: t["tok"]), " ")


def mention_shingles(e1_type: Column, e2_type: Column, bef: Column, bet: Column, aft: Column) -> Column:
    """The whole bag; ``bef``, ``bet`` and ``aft`` are tagged arrays."""

    def build(b: Column) -> Column:
        before, between, after = b["bef"], b["bet"], b["aft"]
        bag = F.concat(
            entity_type_shingles(e1_type, e2_type),
            phrase_shingles(between),
            verb_shingles(before, "BEF"),
            verb_shingles(between, "BET"),
            verb_shingles(after, "AFT"),
            preposition_shingles(between),
            noun_shingles(between),
            char_ngrams(_text(before), "BEF"),
            char_ngrams(_text(between), "BET"),
            char_ngrams(_text(after), "AFT"),
        )
        return drop_empty(bag)

    return let(F.struct(bef.alias("bef"), bet.alias("bet"), aft.alias("aft")), build)


def drop_empty(bag: Column) -> Column:
    return F.filter(bag, lambda s: s != "")
