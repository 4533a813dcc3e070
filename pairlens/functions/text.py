"""Tagged text: tags, tokens, entities and where the entities occur."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.columns import indexes, let, ngrams

# The inline markup of the corpus.
TAG = r"</?[A-Z]+>"
SPAN = r"<([A-Z]+)>([^<]+)</[A-Z]+>"
SPAN_WITH_CLOSE = r"<([A-Z]+)>([^<]+)</([A-Z]+)>"

# Penn Treebank word rules, applied in this order.  They use no look-around, so any
# regex dialect runs them.
PTB_RULES = [
    (r'(^|[ (\[{<])"', "$1 `` "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([^.])\.([\])}>\"']*)\s*$", "$1 . $2 "),
    (r"\.\.\.|--|[;@#$%&?!\[\](){}<>]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"^(.*)$", " $1 "),
    (r'"', " '' "),
    (r"([^\s])''", "$1 '' "),
    (r"([^' ])('[sSmMdD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(?:(can)(not)|(gim)(me)|(gon)(na)|(got)(ta)|(lem)(me)|(wan)(na))\b", "$1$3$5$7$9$11 $2$4$6$8$10$12"),
    (r"(?i)\b(?:(d)('ye)|(mor)('n))\b", "$1$3 $2$4"),
    (r"(?i) ('t)(is|was)\b", " $1 $2"),
]
# Rules that can only fire when the text holds a quotation mark or apostrophe.
QUOTE_RULES = {0, 4, 5, 6, 7, 8, 9, 11, 12}
# Text without any of this is split on whitespace alone.
NEEDS_RULES = r"(?i)[^a-z0-9_\s]|cannot|gimme|gonna|gotta|lemme|wanna"

# Tokens that never carry a relation.
BAD_TOKENS = [",", "(", ")", ";", "''", "``", "'s", "-", "vs.", "v", "'", ":", ".", "--"]
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def _apply_rules(text: Column, rules) -> Column:
    for n in rules:
        pattern, replacement = PTB_RULES[n]
        if n == 5:  # pad, as the later rules look for a following space
            text = F.concat(F.lit(" "), text, F.lit(" "))
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def tokenize(text: Column) -> Column:
    """Treebank word tokens of one sentence per row."""
    every = range(len(PTB_RULES))

    def spaced(raw: Column) -> Column:
        quoted = F.contains(raw, F.lit('"')) | F.contains(raw, F.lit("'"))
        return (
            F.when(~raw.rlike(NEEDS_RULES), raw)
            .when(quoted, _apply_rules(raw, every))
            .otherwise(_apply_rules(raw, [n for n in every if n not in QUOTE_RULES]))
        )

    return let(text, lambda raw: F.regexp_extract_all(spaced(raw), F.lit(r"\S+"), F.lit(0)))


def token_bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs; the joined text is tokenised again first, as phrases are elsewhere."""
    return ngrams(tokenize(F.array_join(tokens, " ")), 2)


def extract_entities(text: Column) -> Column:
    """Every tagged span as ``(s, ty)``; the type is the opening tag's."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(SPAN), F.lit(2)),
        F.regexp_extract_all(text, F.lit(SPAN), F.lit(1)),
        lambda s, ty: F.struct(s.alias("s"), ty.alias("ty")),
    )


def has_two_entities(text: Column) -> Column:
    """Cheap row filter: at least two tagged spans."""
    return F.regexp_count(text, F.lit(SPAN)) >= 2


def has_spans(text: Column) -> Column:
    """Cheaper still, for what counts the spans itself: there may be a tagged span."""
    return F.contains(text, F.lit("</"))


def entity_parts(name: Column) -> Column:
    """Tokens of a name; a final lone period goes back to the token before it (``Inc .`` -> ``Inc.``)."""

    def glue(parts: Column) -> Column:
        n = F.size(parts)
        glued = F.concat(
            F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))),
            F.array(F.concat(F.get(parts, n - 2), F.get(parts, n - 1))),
        )
        return F.when((n >= 2) & (F.get(parts, n - 1) == "."), glued).otherwise(parts)

    return let(tokenize(name), glue)


def positions_of(parts: Column, tokens: Column) -> Column:
    """0-based starts of every occurrence of ``parts`` in ``tokens``."""
    return F.filter(
        indexes(tokens),
        lambda i: (F.get(tokens, i) == F.get(parts, F.lit(0))) & (F.slice(tokens, i + 1, F.size(parts)) == parts),
    )


def distinct_entities(text: Column) -> Column:
    return F.array_distinct(extract_entities(text))


def locate_entities(entities: Column, tokens: Column) -> Column:
    """One ``(pos, len, ty, s)`` per start position, ascending.

    Names are searched in all tokens, so an untagged repeat of a tagged name counts.  When several
    entities start at one position the longest wins, then the smaller type, then the smaller name.
    """

    def occurrences(ent: Column) -> Column:
        return let(
            entity_parts(ent["s"]),
            lambda parts: F.transform(
                positions_of(parts, tokens),
                lambda pos: F.struct(
                    pos.alias("pos"),
                    (-F.size(parts)).alias("neg_len"),
                    ent["ty"].alias("ty"),
                    ent["s"].alias("s"),
                ),
            ),
        )

    def first_per_position(found: Column) -> Column:
        kept = F.filter(
            F.transform(found, lambda x, i: F.struct(x.alias("x"), F.get(found, i - 1)["pos"].alias("prev"))),
            lambda y: y["prev"].isNull() | (y["prev"] != y["x"]["pos"]),
        )
        return F.transform(
            kept,
            lambda y: F.struct(
                y["x"]["pos"].alias("pos"),
                (-y["x"]["neg_len"]).alias("len"),
                y["x"]["ty"].alias("ty"),
                y["x"]["s"].alias("s"),
            ),
        )

    return let(F.sort_array(F.flatten(F.transform(entities, occurrences))), first_per_position)


def is_relational(tokens: Column) -> Column:
    """True unless every token is a stop word or bad token (an empty context is not relational)."""
    return F.exists(tokens, lambda t: ~t.isin(BAD_TOKENS + STOP_WORDS))
