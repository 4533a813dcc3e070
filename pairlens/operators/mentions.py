"""Sentences -> pairs of neighbouring entities with their contexts.

The whole chain is one Arrow kernel over batches of sentences followed by a single explode: no shuffle, and every
test sits before the explode so dropped pairs never become rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import scan
from pairlens.functions import text as tx
from pairlens.functions.columns import first_n, last_n, let
from pairlens.functions.tagger import ModelTagger, with_lemmas
from pairlens.functions.tagging import tag_tokens

# Fixed values.
MAX_TOKENS_AWAY = 6
MIN_TOKENS_AWAY = 1
EVALUATION_WINDOW = 2
FEATURE_WINDOW = 3


def neighbour_pairs(located: Column) -> Column:
    """Entity i with entity i+1, in position order."""
    pairs = F.transform(located, lambda x, i: F.struct(x.alias("a"), F.get(located, i + 1).alias("b")))
    return F.filter(pairs, lambda p: p["b"].isNotNull())


def pair_is_valid(pair: Column, types: Iterable[tuple[str, str]] | None = None) -> Column:
    gap = pair["b"]["pos"] - pair["a"]["pos"]
    ok = gap.between(MIN_TOKENS_AWAY, MAX_TOKENS_AWAY) & (pair["a"]["s"] != pair["b"]["s"])
    if types is not None:
        allowed = F.lit(False)
        for first, second in sorted(set(types)):
            allowed = allowed | ((pair["a"]["ty"] == first) & (pair["b"]["ty"] == second))
        ok = ok & allowed
    return ok


def with_contexts(pair: Column, tokens: Column, window: int) -> Column:
    start1, end1 = pair["a"]["pos"], pair["a"]["pos"] + pair["a"]["len"]
    start2, end2 = pair["b"]["pos"], pair["b"]["pos"] + pair["b"]["len"]
    before = F.slice(tokens, F.lit(1), start1)
    between = F.slice(tokens, end1 + 1, F.greatest(start2 - end1, F.lit(0)))
    after = F.slice(tokens, end2 + 1, F.size(tokens))
    return F.struct(
        pair["a"]["s"].alias("e1"),
        pair["a"]["ty"].alias("e1_type"),
        pair["b"]["s"].alias("e2"),
        pair["b"]["ty"].alias("e2_type"),
        last_n(before, window).alias("bef"),
        between.alias("bet"),
        first_n(after, window).alias("aft"),
        (start2 - start1).alias("gap"),
    )


def mentions_of(text_col: str, window: int = EVALUATION_WINDOW, types: tuple[tuple[str, str], ...] | None = None, with_near: bool = False) -> Column:
    """Array of mentions of the tagged sentence in column ``text_col``; ``with_near`` as in ``support.flag_near_mentions``."""
    return scan.mentions_column(F.col(text_col), window, MIN_TOKENS_AWAY, MAX_TOKENS_AWAY, types, with_near)


def exploded(rows: DataFrame, arrays: Column, name: str = "m") -> DataFrame:
    """All columns and one row per element; the outer form keeps Spark from testing for empty arrays with a second run of the kernel."""
    return rows.select("*", F.explode_outer(arrays).alias(name)).filter(F.col(name).isNotNull())


def as_key(types: Iterable[tuple[str, str]] | None) -> tuple[tuple[str, str], ...] | None:
    return None if types is None else tuple(sorted(set(types)))


def extract_mentions(
    sentences: DataFrame,
    window: int = EVALUATION_WINDOW,
    types: Iterable[tuple[str, str]] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``sentences`` plus one row per mention."""
    rows = exploded(sentences.filter(tx.has_spans(F.col(text_col))), mentions_of(text_col, window, as_key(types)))
    return rows.select(*sentences.columns, "m.e1", "m.e1_type", "m.e2", "m.e2_type", "m.bef", "m.bet", "m.aft", "m.gap")


def tagged_sentences(sentences: DataFrame, tagger: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """All columns plus ``words``, the tokens of the whole sentence, and ``tagged``, their tags and lemmas."""
    worded = sentences.select("*", tx.tokenize(tx.strip_tags(F.col(text_col))).alias("words"))
    return worded.select("*", tag_tokens(F.col("words"), tagger).alias("tagged"))


def tagged_mentions(
    sentences: DataFrame,
    tagger: Callable[[Column], Column],
    window: int = FEATURE_WINDOW,
    types: Iterable[tuple[str, str]] | None = None,
    text_col: str = "text",
    lemmas: bool = True,
) -> DataFrame:
    """Mentions as ``extract_mentions`` finds them, with contexts of tagged tokens.

    The tagger sees whole sentences, names included; contexts are cut from what it gives, by position. A trained model tags in the
    scan that finds the mentions, each sentence with a mention once; without ``lemmas`` its tokens have none yet.
    """
    if isinstance(tagger, ModelTagger):
        arrays = scan.tagged_column(F.col(text_col), window, MIN_TOKENS_AWAY, MAX_TOKENS_AWAY, as_key(types), *tagger.states())
        rows = exploded(sentences.filter(tx.has_spans(F.col(text_col))), arrays)
        parts = [(with_lemmas(F.col(f"m.{c}")) if lemmas else F.col(f"m.{c}")).alias(c) for c in ("bef", "bet", "aft")]
        return rows.select(*sentences.columns, *[f"m.{c}" for c in ("e1", "e1_type", "e2", "e2_type")], *parts, "m.gap")
    found = exploded(sentences.filter(tx.has_spans(F.col(text_col))), mentions_of(text_col, window, as_key(types)))
    rows = tagged_sentences(found, tagger, text_col)

    def cut(start: Column, end: Column) -> Column:
        return F.slice("tagged", start + 1, F.greatest(end - start, F.lit(0)))

    bef = cut(F.greatest(F.col("m.start1") - window, F.lit(0)), F.col("m.start1"))
    bet, aft = cut(F.col("m.end1"), F.col("m.start2")), cut(F.col("m.end2"), F.col("m.end2") + window)
    return rows.select(
        *sentences.columns, *[f"m.{c}" for c in ("e1", "e1_type", "e2", "e2_type")], bef.alias("bef"), bet.alias("bet"), aft.alias("aft"), "m.gap"
    )


def distinct_mentions(mentions: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """De-duplicated mentions with the number of occurrences ``n``; copies merge before the shuffle."""
    cols = [*keys, "e1_type", "e2_type", "e1", "e2", "bef", "bet", "aft"]
    return mentions.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def known_pair_contexts(
    text: Column, e1: Column, e2: Column, window: int = FEATURE_WINDOW, forward_only: bool = True, tagged: Column | None = None
) -> Column:
    """Contexts of every occurrence of a *given* pair within the distance limit, in position order, cut from ``tagged`` if given.

    ``forward_only`` keeps occurrences with e1 in front; otherwise the distance is absolute and a
    reversed occurrence has an empty BET.
    """
    if tagged is None:
        return scan.known_pair_column(text, e1, e2, window, MIN_TOKENS_AWAY, MAX_TOKENS_AWAY, forward_only)

    def per_sentence(tokens: Column) -> Column:
        def at(parts1: Column) -> Column:
            def pair_up(parts2: Column) -> Column:
                combos = F.flatten(
                    F.transform(
                        tx.positions_of(parts1, tokens),
                        lambda i: F.transform(
                            tx.positions_of(parts2, tokens),
                            lambda j: F.struct(
                                F.struct(i.alias("pos"), F.size(parts1).alias("len"), F.lit("").alias("ty"), e1.alias("s")).alias("a"),
                                F.struct(j.alias("pos"), F.size(parts2).alias("len"), F.lit("").alias("ty"), e2.alias("s")).alias("b"),
                            ),
                        ),
                    )
                )
                gap = (lambda p: p["b"]["pos"] - p["a"]["pos"]) if forward_only else (
                    lambda p: F.abs(p["b"]["pos"] - p["a"]["pos"])
                )
                return F.filter(combos, lambda p: gap(p).between(MIN_TOKENS_AWAY, MAX_TOKENS_AWAY))

            return let(tx.entity_parts(e2), pair_up)

        return F.transform(
            let(tx.entity_parts(e1), at),
            lambda p: with_contexts(p, tagged, window).dropFields("e1_type", "e2_type"),
        )

    return let(tx.tokenize(tx.strip_tags(text)), per_sentence)
