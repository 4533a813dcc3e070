"""All settings of signatures x bands x neighbours in one run.

Signatures are made once at the largest size; a smaller setting is a prefix.  Settings whose bands are equally wide
share them, so a band is looked up once for all settings that have it.  What the facts say is counted for sets of
settings, kept as bits, and taken apart by setting when only sums are left.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import minhash as mh
from pairlens.operators import neighbours as nb
from pairlens.operators import support as sp
from pairlens.plans import evaluate as ev
from pairlens.session import materialise, spread
from pairlens.sources.records import facts_of_classified

# The grid.
SIGS = [100, 200, 300, 400, 500, 600]
BANDS = [25, 50, 75, 100, 150]
NEIGHBOURS = [1, 3, 5, 7]

SETTING = ["sigs", "bands"]


def split_grid(sigs: Iterable[int] = SIGS, bands: Iterable[int] = BANDS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(usable, unusable) settings; signatures must be a multiple of bands."""
    pairs = [(s, b) for s in sigs for b in bands]
    return [p for p in pairs if p[0] % p[1] == 0], [p for p in pairs if p[0] % p[1]]


def shared_bands(settings: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The widths of the bands of all settings, and the most bands of each width that one of them has."""
    widths: dict[int, int] = {}
    for s, b in settings:
        width = mh.rows_per_band(s, b)
        widths[width] = max(b, widths.get(width, 0))
    return widths


def chunk_rows(signed: DataFrame, settings: list[tuple[int, int]], keep: Iterable[str]) -> DataFrame:
    """(width, band, key) of every band of any setting, once."""
    chunks = mh.chunk_keys(F.col("sig"), shared_bands(settings))
    return signed.select(*keep, F.explode_outer(chunks).alias("b")).select(*keep, "b.*")


def sweep_labels(
    labelled: DataFrame,
    bags: DataFrame,
    settings: list[tuple[int, int]],
    neighbours: Iterable[int] = NEIGHBOURS,
) -> DataFrame:
    """(sigs, bands, k, bag, rel_type, votes) for signed ``labelled`` and ``bags``."""
    ks = sorted(set(neighbours))
    sizes = sorted({s for s, _ in settings})
    keys = ["width", "band", "key"]
    buckets = nb.last_writers(chunk_rows(labelled, settings, ["rel_id"]), keys)
    met = chunk_rows(bags, settings, ["bag"]).join(buckets, keys)
    # The first band in which the two met, of each width: they meet in every setting that has so many bands of this width.
    first = {w: F.min(F.when(F.col("width") == w, F.col("band"))).alias(f"first_{w}") for w in shared_bands(settings)}
    pairs = met.groupBy("bag", "rel_id").agg(*first.values())
    both = pairs.join(labelled.select("rel_id", "rel_type", F.col("sig").alias("other_sig")), "rel_id").join(
        bags.select("bag", "sig"), "bag"
    )
    both = both.withColumn("same", mh.prefix_matches(F.col("sig"), F.col("other_sig"), sizes))

    def scored_in(s: int, b: int) -> Column:
        share = F.get("same", F.lit(sizes.index(s))) / F.lit(float(s))
        score = F.struct(F.lit(s).alias("sigs"), F.lit(b).alias("bands"), share.alias("similarity"))
        return F.when(F.col(f"first_{mh.rows_per_band(s, b)}") < b, score)

    # One row per setting in which the two met; at most as many as there are settings.
    every = F.array_compact(F.array(*[scored_in(s, b) for s, b in settings]))
    scored = both.select("bag", "rel_id", "rel_type", F.explode_outer(every).alias("s")).select(
        *[f"s.{c}" for c in SETTING], "bag", "rel_id", "rel_type", "s.similarity"
    )
    query = [*SETTING, "bag"]
    top = nb.top_k_neighbours(scored, ks[-1], query)
    per_k = top.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))))
    asked = [*SETTING, "k", "bag"]
    return nb.majority(nb.vote_counts(per_k, asked), asked)


def sweep_metrics(
    labels: DataFrame, mentions: DataFrame, kb: DataFrame, stats: ev.CorpusStatistics, catalogue: DataFrame, grid: list[tuple[int, int, int]]
) -> DataFrame:
    """P, R and F1 per (sigs, bands, k, rel_type); ``grid`` are the settings (sigs, bands, k) of the labels.

    ``mentions(bags, e1, e2, bet, n_facts)`` are the classified facts, copies merged.  Facts whose bags get the
    same labels in all settings are merged before they are counted per setting.  What the corpus and the
    knowledge base say about a pair does not depend on the setting: the totals of c and d are counted once,
    and each setting subtracts the pairs it found.
    """
    setting = [*SETTING, "k"]
    bits = bit_columns(grid)
    vectors = materialise(label_vectors(mentions.select("bags").distinct(), labels, grid), "sweep-vectors")
    merged = mentions.join(vectors.select("bags", "vector"), "bags").groupBy("vector", "e1", "e2", "bet").agg(
        F.sum("n_facts").alias("n_facts")
    )
    # A row for each relation that any setting gives, with the bits of the settings that do.
    each = vectors.select("vector", "answers").dropDuplicates(["vector"]).select("vector", F.explode("answers").alias("answer"))
    facts = merged.join(each.select("vector", "answer.*"), "vector")
    facts = materialise(facts.select("vector", *ev.TRIPLE_KEY, "n_facts", *bits), "sweep-facts")
    triples = facts.select(*ev.TRIPLE_KEY).distinct()
    verdicts = sp.exact_phrase_verdicts(triples, stats.phrases, catalogue).select(*ev.TRIPLE_KEY, "supported")
    known = materialise(stats_with_kb(stats.pairs, kb), "sweep-pairs")
    totals = known.groupBy("rel_type").agg(
        F.count_if("c_pair").alias("c_total"), F.count_if("d_pair").alias("d_total")
    )
    judged = facts.join(verdicts, ev.TRIPLE_KEY).join(known, ev.PAIR_KEY, "left")
    in_kb = F.coalesce(F.col("known"), F.lit(False))
    judged = materialise(judged.withColumns({"in_b": in_kb, "in_a": ~in_kb & F.col("supported")}), "sweep-judged")
    of_vector = judged.groupBy("vector", "rel_type", *bits).agg(
        F.sum("n_facts").alias("s"), *[F.sum(F.when(F.col(f"in_{c}"), F.col("n_facts")).otherwise(0)).alias(c) for c in ("a", "b")]
    )
    sizes = by_setting(of_vector, grid).groupBy(*setting, "rel_type").agg(*[F.sum(c).alias(c) for c in ("s", "a", "b")])

    def pairs_found(pair: str, region: str) -> DataFrame:
        """How many of the pairs each setting found."""
        own = judged.filter(F.col(pair) & F.col(f"in_{region}")).groupBy(*ev.PAIR_KEY).agg(*[F.bit_or(b).alias(b) for b in bits])
        sets = own.groupBy("rel_type", *bits).agg(F.count(F.lit(1)).alias("n"))
        return by_setting(sets, grid).groupBy(*setting, "rel_type").agg(F.sum("n").alias(f"{pair[0]}_found"))

    of_relation = [*setting, "rel_type"]
    for pair, region in (("c_pair", "b"), ("d_pair", "a")):
        sizes = sizes.join(pairs_found(pair, region), of_relation, "left")
    sizes = sizes.withColumns({f"{c}_found": F.coalesce(f"{c}_found", F.lit(0)) for c in ("c", "d")})
    # A relation outside the catalogue has facts but nothing in the corpus, so its totals are zero.
    sizes = sizes.join(F.broadcast(totals_of(catalogue, totals)), "rel_type", "left").withColumns(
        {f"{c}_pairs": F.coalesce(f"{c}_total", F.lit(0)) - F.col(f"{c}_found") for c in ("c", "d")}
    )
    return ev.evaluation_metrics(sizes).select(*setting, "rel_type", "s", "a", "b", "c_pairs", "d_pairs", "precision", "recall", "f1")


#: Settings of which one number holds the bits.
BITS = 62


def bit_columns(grid: list[tuple[int, int, int]]) -> list[str]:
    """Columns of numbers whose bits are the settings (sigs, bands, k) of the grid, in its order."""
    return [f"bits_{i}" for i in range(-(-len(grid) // BITS))]


def by_setting(rows: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each setting whose bit is set, with the columns sigs, bands and k in place of the bits."""
    bits = bit_columns(grid)
    places = F.array(*[
        F.when(F.getbit(F.col(bits[i // BITS]), F.lit(i % BITS)) == 1, F.struct(*[F.lit(v).alias(c) for v, c in zip(one, [*SETTING, "k"])]))
        for i, one in enumerate(grid)
    ])
    rest = [c for c in rows.columns if c not in bits]
    return rows.select(*rest, F.explode_outer(F.array_compact(places)).alias("at")).select("at.*", *rest)


def label_vectors(groups: DataFrame, labels: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    """(bags, answers, vector): the relations that the bags of a group get, each with the bits of the settings that give it, and a 128-bit key."""
    bits = bit_columns(grid)
    base = max(max(one) for one in grid) + 1
    numbers = F.array(*[F.lit((s * base + b) * base + k).cast("bigint") for s, b, k in grid])
    own = (F.col("sigs").cast("bigint") * base + F.col("bands")) * base + F.col("k")
    place = F.array_position(numbers, own).cast("int") - 1
    set_in = {
        b: F.when(F.floor(F.col("place") / BITS) == i, F.expr(f"shiftleft(1L, place % {BITS})")).otherwise(F.lit(0).cast("bigint"))
        for i, b in enumerate(bits)
    }
    merged = [F.bit_or(b).alias(b) for b in bits]
    of_bag = labels.withColumn("place", place).select("bag", "rel_type", *[c.alias(b) for b, c in set_in.items()])
    of_bag = of_bag.groupBy("bag", "rel_type").agg(*merged)
    named = groups.select("bags", F.explode("bags").alias("bag")).join(of_bag, "bag")
    every = named.groupBy("bags", "rel_type").agg(*merged)
    every = every.groupBy("bags").agg(F.sort_array(F.collect_list(F.struct("rel_type", *bits))).alias("answers"))
    parts = [F.size("answers"), F.col("answers")]
    return every.withColumn("vector", F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")))


def facts_by_bags(mentions: DataFrame) -> DataFrame:
    """(bags, e1, e2, bet, n_facts): the facts that labelling the mentions (bag, e1, e2, sentence) states.

    A sentence states a pair's relation once for each place where the pair stands, whichever of its mentions has the
    label.  So a fact depends on the labels of all bags that its pair has in its sentence; most have one.
    """
    pairs = mentions.groupBy("e1", "e2", "sentence").agg(F.sort_array(F.collect_set("bag")).alias("bags"))
    facts = facts_of_classified(pairs).select("bags", "e1", "e2", "sentence", "bet").distinct()
    return facts.groupBy("bags", "e1", "e2", "bet").agg(F.count(F.lit(1)).alias("n_facts"))


def stats_with_kb(pairs: DataFrame, kb: DataFrame) -> DataFrame:
    """Per pair of the corpus or the knowledge base: is it known, and would it be in c or d if nobody found it."""
    merged = ev.split_by_kb(pairs, kb)
    stated = F.col("keyword_mentions") > 0
    return merged.select(
        *ev.PAIR_KEY,
        "known",
        (F.col("known") & stated).alias("c_pair"),
        (~F.col("known") & stated & sp.well_supported(F.col("total"), F.col("with_word"))).alias("d_pair"),
    )


def totals_of(catalogue: DataFrame, totals: DataFrame) -> DataFrame:
    """At most one row per relation of the catalogue."""
    joined = catalogue.select("rel_type").join(totals, "rel_type", "left")
    return joined.select("rel_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("c_total", "d_total")])


def macro_average(results: DataFrame) -> DataFrame:
    """Mean F1 over the relations present, per setting, with their number."""
    return results.groupBy("sigs", "bands", "k").agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("relations")
    )


def parameter_sweep(
    training_features: DataFrame,
    mentions: DataFrame,
    features: DataFrame,
    kb: DataFrame,
    stats: ev.CorpusStatistics,
    catalogue: DataFrame,
    sigs: Iterable[int] = SIGS,
    bands: Iterable[int] = BANDS,
    neighbours: Iterable[int] = NEIGHBOURS,
) -> DataFrame:
    """Results table of every usable setting.

    ``training_features(rel_id, rel_type, shingles)``; ``mentions(bag, e1, e2, sentence)`` and ``features(bag, shingles)``
    as ``classify.context_features`` gives them.  Every setting counts what a single run with it evaluates.
    """
    settings, _ = split_grid(sigs, bands)
    most = max(s for s, _ in settings)
    rows = nb.with_bag(training_features, "shingles")
    signed = materialise(nb.signatures(spread(rows.select("bag", "shingles").distinct(), "bag"), most, ["bag"]), "sweep-index-bags")
    labelled = materialise(nb.last_of_bags(materialise(rows.drop("shingles"), "sweep-rows"), signed), "sweep-labelled")
    bags = materialise(nb.signatures(features, most, ["bag"]), "sweep-bags")
    labels = materialise(sweep_labels(spread(labelled, "rel_id"), spread(bags, "bag"), settings, neighbours), "sweep-labels")
    grid = [(*setting, k) for setting in settings for k in sorted(set(neighbours))]
    return sweep_metrics(labels, facts_by_bags(mentions), kb, stats, catalogue, grid)
