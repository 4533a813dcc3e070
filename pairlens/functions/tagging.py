"""Part-of-speech tags and lemmas for tokens.

A tagged token is ``struct<tok, tag, lemma>``.  Three ways to get them: the built-in rules below (a
closed-class word list and suffix rules, all native), a lexicon table (``tag_with_lexicon``), or any
column function that maps ``array<string>`` to the tagged array, for example a pandas UDF around a
trained tagger.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.columns import let

TAGGED = "array<struct<tok:string,tag:string,lemma:string>>"

# Closed-class words, by Penn Treebank tag.
CLOSED_CLASS = {
    "IN": "of in for on with at by from as into about between through during against among since until without "
    "within under over after before because while if than that",
    "TO": "to",
    "DT": "the a an this these those some any no every each all both",
    "PRP": "i you he she it we they me him us them himself herself itself themselves",
    "PRP$": "my your his its our their",
    "CC": "and or but nor yet",
    "WDT": "which",
    "WP": "who whom what",
    "WRB": "when where why how",
    "EX": "there",
    "MD": "can could may might must shall should will would",
    "RB": "not also very now then here never always often too only n't",
    "RP": "up off out",
}
# Frequent irregular verb forms as (form, tag, lemma).
VERB_FORMS = [
    ("be", "VB", "be"), ("am", "VBP", "be"), ("is", "VBZ", "be"), ("are", "VBP", "be"), ("was", "VBD", "be"),
    ("were", "VBD", "be"), ("been", "VBN", "be"), ("being", "VBG", "be"), ("have", "VBP", "have"),
    ("has", "VBZ", "have"), ("had", "VBD", "have"), ("having", "VBG", "have"), ("do", "VBP", "do"),
    ("does", "VBZ", "do"), ("did", "VBD", "do"), ("done", "VBN", "do"), ("bought", "VBD", "buy"),
    ("sold", "VBD", "sell"), ("made", "VBD", "make"), ("led", "VBD", "lead"), ("held", "VBD", "hold"),
    ("took", "VBD", "take"), ("taken", "VBN", "take"), ("gave", "VBD", "give"), ("given", "VBN", "give"),
    ("said", "VBD", "say"), ("won", "VBD", "win"), ("left", "VBD", "leave"), ("built", "VBD", "build"),
    ("born", "VBN", "bear"), ("wrote", "VBD", "write"), ("written", "VBN", "write"), ("ran", "VBD", "run"),
    ("grew", "VBD", "grow"), ("found", "VBD", "find"), ("met", "VBD", "meet"), ("became", "VBD", "become"),
]
# Verbs whose third person would pass for a plural.
THIRD_PERSON_OF = (
    "own acquire buy sell employ keep work ship make lead hold take give say win leave build write run grow find meet become "
    "found start open close join marry study teach live move play serve produce publish direct manage control operate "
    "represent succeed include contain require provide supply need want know think believe call become remain appear "
    "begin continue create develop design invest merge hire appoint marry attend graduate reside die"
).split()


def third_person(verb: str) -> str:
    if verb.endswith("y") and verb[-2] not in "aeiou":
        return verb[:-1] + "ies"
    return verb + ("es" if verb.endswith(("s", "x", "z", "ch", "sh", "o")) else "s")


def word_entries() -> list[tuple[str, str, str]]:
    """(word, tag, lemma) of the word list; a word stands once."""
    listed = [(w, tag, w) for tag, words in CLOSED_CLASS.items() for w in words.split()] + VERB_FORMS
    known = {w for w, _, _ in listed}
    forms = {third_person(v): v for v in THIRD_PERSON_OF}
    return listed + [(form, "VBZ", verb) for form, verb in forms.items() if form not in known]


def _word_list() -> Column:
    """Constant map word -> (tag, lemma); one lookup serves both."""
    entries = word_entries()

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "\\'") + "'"

    pairs = [f"{quoted(w)}, named_struct('tag', {quoted(t)}, 'lemma', {quoted(m)})" for w, t, m in entries]
    return F.expr(f"map({', '.join(pairs)})")


def _listed(low: Column) -> Column:
    """Tag and lemma of a listed word, else null; a constant map is searched from its start, so only listed words are looked up."""
    return F.when(low.isin([w for w, _, _ in word_entries()]), F.try_element_at(_word_list(), low))


def lemma_of(low: Column, tag: Column) -> Column:
    """Lemma of a small-letter word under a tag: the word list's where it has the word with this tag, else by rule."""
    hit = _listed(low)
    return F.when(hit["tag"] == tag, hit["lemma"]).otherwise(_rule_lemma(low, tag))


def _rule_lemma(low: Column, tag: Column) -> Column:
    stem = F.regexp_replace(low, r"(?:ed|ing)$", "")
    undoubled = F.regexp_replace(stem, r"(b|d|g|m|n|p|r|t)\1$", "$1")
    verb = F.when(low.endswith("ied"), F.regexp_replace(low, "ied$", "y")).when(undoubled != stem, undoubled).when(stem.rlike(r"(?:at|iz|as|us|c|g|v|u|[^aeo]ir)$"), F.concat(stem, F.lit("e"))).otherwise(stem)
    noun = F.when(low.rlike("ies$"), F.regexp_replace(low, "ies$", "y")).when(
        low.rlike("(?:ss|x|ch|sh)es$"), F.regexp_replace(low, "es$", "")
    ).otherwise(F.regexp_replace(low, "s$", ""))
    return F.when(tag.isin("VBN", "VBG"), verb).when(tag == "NNS", noun).otherwise(low)


def tag_token(token: Column) -> Column:
    """Built-in tag and lemma of one token."""

    def build(low: Column) -> Column:
        open_tag = (
            F.when(~token.rlike(r"[A-Za-z]"), F.when(token.rlike(r"[0-9]"), "CD").otherwise(token))
            .when(token == "'s", "POS")
            .when(token.rlike(r"^[A-Z]"), "NNP")
            .when(low.endswith("ing"), "VBG")
            .when(low.endswith("ed"), "VBN")
            .when(low.endswith("ly"), "RB")
            .when(low.rlike(r"(?:ous|ful|ive|able|ible|ical|ish|less|large)$"), "JJ")
            .when(low.rlike(r"[^s]s$"), "NNS")
            .otherwise("NN")
        )

        def unlisted() -> Column:
            return let(
                open_tag,
                lambda tg: F.struct(token.alias("tok"), tg.alias("tag"), _rule_lemma(low, tg).alias("lemma")),
            )

        return let(
            _listed(low),
            lambda hit: F.when(
                hit.isNotNull(), F.struct(token.alias("tok"), hit["tag"].alias("tag"), hit["lemma"].alias("lemma"))
            ).otherwise(unlisted()),
        )

    return let(F.lower(token), build)


def tag_tokens(tokens: Column, tagger: Callable[[Column], Column] | None = None) -> Column:
    """Tagged array of a token array; ``tagger`` replaces the built-in rules."""
    if tagger is not None:
        return tagger(tokens).cast(TAGGED)
    return F.transform(tokens, tag_token)


def tag_with_lexicon(rows: DataFrame, key: str, tokens: str, lexicon: DataFrame, out: str = "tagged") -> DataFrame:
    """Tag by a lexicon table ``(token, tag, lemma)``; tokens it lacks fall back to the built-in rules.

    ``key`` must identify a row.  Spark broadcasts the lexicon while its measured size allows it and
    joins by shuffle beyond that; the regrouping is bounded by the length of one context.
    """
    looked_up = rows.select(key, F.posexplode(tokens).alias("i", "tok")).join(
        lexicon.select(F.col("token").alias("tok"), F.col("tag").alias("lex_tag"), F.col("lemma").alias("lex_lemma")),
        "tok",
        "left",
    )
    built = looked_up.select(key, "i", "tok", "lex_tag", "lex_lemma", tag_token(F.col("tok")).alias("rule"))
    one = F.struct(
        "i",
        F.struct(
            "tok",
            F.coalesce("lex_tag", "rule.tag").alias("tag"),
            F.coalesce("lex_lemma", "rule.lemma").alias("lemma"),
        ).alias("t"),
    )
    grouped = built.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("ts"))
    grouped = grouped.select(key, F.transform("ts", lambda x: x["t"]).alias(out))
    empty = F.array().cast(TAGGED)
    return rows.join(grouped, key, "left").withColumn(out, F.coalesce(out, empty))
