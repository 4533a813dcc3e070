"""Near duplicates by shared word shingles: MinHash bands propose, the texts decide.

Two documents are near duplicates if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; shorter texts
are one shingle. Documents of one set are one class, so exact copies are gone before anything is emitted. Each class emits 20
keys of 4 minima each: a pair of similarity 0.8 shares none of them with a probability of 3 in 100,000, a closer pair with less.

Under a key with up to ``FULL`` classes all pairs are candidates. Under a fuller one each class first meets a few centres, the same
ones under all keys as far as they are there; classes that the links found so far connect are in one group, and only
classes of different groups meet under the key once more. So a large group of copies costs pairs in proportion to its size,
and no pair under a key goes untested. Candidates are held against sketches (which of 512 ranges of hashes a set has, and two bits
of the smallest in each) before any text moves: sizes and sketches rule out what is far below the similarity, and a pair at 0.8
with a chance below 1 in 100,000. The rest is decided by the sets of shingles themselves; documents connected by verified links
are one group.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import ROW, in_batches, keeps_columns, numbered, only_rows
from pairlens.llm.components import connected_components
from pairlens.session import materialise

WORDS = 5
SIMILAR = 0.8
BANDS = 20
MINIMA = 4
#: Classes under a key up to which all their pairs are candidates at once.
FULL = 32
#: Classes with which each one under a fuller key is tested first.
CENTRES = 4
#: Blocks over which a full key is dealt.
BLOCKS = 8
#: Ranges of hashes in a sketch, in 64-bit words.
RANGES = 8
#: Standard deviations below its expectation at which a sketch rules a pair out.
DEVIATIONS = 4.5
#: Shingle sets that a task remembers while it verifies, in shingles.
REMEMBERED = 2_000_000

_RANDOM = np.random.default_rng(5)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * MINIMA, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles, case of A-Z aside."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    size = min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - size + 1
    cuts = map(slice, starts[:n].tolist(), ends[size - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(0)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of a non-empty set, as signed longs."""
    import xxhash

    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[None, i : i + 4096] * FACTORS[:, None] + SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    keys = [xxhash.xxh3_64_intdigest(own.tobytes(), band) for band, own in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def marks(hashes: np.ndarray) -> bytes:
    """A sketch of sorted hashes: the ranges that hold any, and the two low bits of the smallest one in each, as bits."""
    there, low, next_low = (np.zeros(64 * RANGES, bool) for _ in range(3))
    ranges = (hashes >> np.uint64(64 - (64 * RANGES - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])[: len(ranges)])
    there[ranges[first]] = True
    low[ranges[first]] = (hashes[first] & np.uint64(1)).astype(bool)
    next_low[ranges[first]] = (hashes[first] & np.uint64(2)).astype(bool)
    return np.packbits(np.concatenate([there, low, next_low])).tobytes()


def flat(side: str) -> list[Column]:
    """The columns of a sketch, named by its side."""
    names = ["size", "filled", *[f"{kind}{i}" for kind in "mxy" for i in range(RANGES)]]
    return [F.col(f"own.{c}").alias(f"{side}_{c}") for c in names]


def may_be_similar(left: str, right: str, similar: float = SIMILAR) -> Column:
    """Whether two sketches, as ``flat`` has them, leave the similarity possible.

    Of u ranges that either set has, those with the same smallest hash are about similar * u; of the c ranges that both have, the
    others agree in both their bits by chance, one in four. So c - 4/3 d estimates them, d being the ranges whose bits differ, and u is the
    sum of what each has, less c. A range of different hashes adds a third to the variance of it.
    The smallest hashes are drawn from all of both sets without putting back, so where sets are small against the ranges, few are left to chance.
    """
    def column(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    def total(word: Callable[[int], Column]) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(word(i)) for i in range(RANGES)])

    shared = [column(left, f"m{i}").bitwiseAND(column(right, f"m{i}")) for i in range(RANGES)]
    both = total(lambda i: shared[i])
    apart = [[column(left, f"{kind}{i}").bitwiseXOR(column(right, f"{kind}{i}")) for i in range(RANGES)] for kind in "xy"]
    differ = total(lambda i: apart[0][i].bitwiseOR(apart[1][i]).bitwiseAND(shared[i]))
    filled = column(left, "filled") + column(right, "filled")
    # Bounded by what each has, so that ``both`` stands in the condition once: longer code would not be compiled to machine code.
    undrawn = 1 - filled / (column(left, "size") + column(right, "size"))
    variance = similar * (1 - similar) / (1 + similar) * filled * undrawn + F.greatest(F.least(column(left, "filled"), column(right, "filled")) - similar / 2 * filled, F.lit(0.0)) / 3
    size = F.least(column(left, "size"), column(right, "size")) + 1e-9 >= similar * F.greatest(column(left, "size"), column(right, "size"))
    return size & ((1 + similar) * both - 4 / 3 * differ >= similar * filled - DEVIATIONS * F.sqrt(variance) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """(name, n1, n2, bands, own) of numbered documents: the name orders rows by id, rows without one last; n1 and n2 name the set
    of shingles, bands are its keys, none for an empty set, own its sketch: size, ranges
    filled, and the words of ``marks``.
    """
    named = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), (ROW, pa.int64())])
    words = [f"{kind}{i}" for kind in "mxy" for i in range(RANGES)]
    own = pa.struct([(c, pa.int64()) for c in ("size", "filled", *words)])
    schema = pa.schema([("name", named), ("n1", pa.int64()), ("n2", pa.int64()), ("bands", pa.list_(pa.int64())), ("own", own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for keys, texts in in_batches(batches):
            sets = [shingles(t) for t in texts]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            bands = [band_keys(s) if len(s) else [] for s in sets]
            made = np.frombuffer(b"".join(map(marks, sets)), np.int64).reshape(-1, 3 * RANGES)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            filled = np.bitwise_count(made[:, :RANGES].view(np.uint64)).sum(axis=1).astype(np.int64)
            held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (sizes, filled, *made.T)], fields=list(own))
            columns = [pa.array(keys, named), *(pa.array(np.ascontiguousarray(names[:, i])) for i in (0, 1)), pa.array(bands, pa.list_(pa.int64())), held]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), ROW)
    kind = f"struct<no_id: boolean, doc_id: long, {ROW}: long>"
    return rows.select(name, F.coalesce("text", F.lit(""))).mapInArrow(run, f"name {kind}, n1 long, n2 long, bands array<long>, own struct<{', '.join(f'{f.name}: long' for f in own)}>")


def met_classes(classes: DataFrame) -> DataFrame:
    """(key, node, n, centres): the classes under each key that several have, how many they are and some of them."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    centres = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("order"), "node")).alias(f"c{i}") for i in range(CENTRES)]
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *centres).filter("n > 1")
    full = full.select(F.col("key").alias("met"), "n", F.array(*[f"c{i}" for i in range(CENTRES)]).alias("centres"))
    return materialise(keyed.join(full, F.col("key") == F.col("met")).select("key", "node", "n", "centres"), "copies-met")


def candidates(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of classes under keys that are not full, and with the centres of full ones, as far as sketches allow."""
    small = met.filter(F.col("n") <= FULL)
    other = small.select(F.col("key").alias("met"), F.col("node").alias("b"))
    pairs = small.select("key", F.col("node").alias("a")).join(other, (F.col("key") == F.col("met")) & (F.col("a") < F.col("b"))).select("a", "b")
    # Of the centres under all its keys a class meets the first of each order, so it has ``CENTRES`` of them however many keys are full.
    firsts = [F.min(F.get("centres", F.lit(i))).alias(f"c{i}") for i in range(CENTRES)]
    stars = met.filter(F.col("n") > FULL).groupBy("node").agg(*firsts)
    stars = stars.select("node", F.explode(F.array_distinct(F.array(*[f"c{i}.node" for i in range(CENTRES)]))).alias("centre")).filter("node <> centre")
    pairs = pairs.unionByName(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))).distinct()
    left, right = classes.select(F.col("node").alias("a"), *flat("left")), classes.select(F.col("node").alias("b"), *flat("right"))
    return pairs.join(left, "a").join(right, "b").filter(may_be_similar("left", "right")).select("a", "b")


def left_candidates(met: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs under full keys that the links found so far do not connect yet, as far as sketches allow.

    Sketches and groups are compared within the join, which Spark splits when a key is skewed, so only what passes is a row.
    """
    full = met.filter(F.col("n") > FULL)
    groups = connected_components(linked, "copies-groups").withColumnRenamed("component", "group")
    rows = full.select("key", "node").join(classes.select("node", "own"), "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    rows = rows.join(full.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")), "node")
    rows = materialise(rows, "copies-full")
    # A full key is dealt out over blocks, in as many partitions as the session has: its pairs are work that few bytes stand for.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("node"), F.lit(BLOCKS)).cast("int")
    left = rows.select("key", block.alias("block"), F.col("node").alias("a"), *flat("left"), F.col("group").alias("one"), F.col("keys").alias("left_keys"))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    right = rows.select(F.col("key").alias("met"), every.alias("part"), F.col("node").alias("b"), *flat("right"), F.col("group").alias("two"), F.col("keys").alias("right_keys"))
    apart = (F.col("key") == F.col("met")) & (F.col("block") == F.col("part")) & (F.col("a") < F.col("b")) & (F.col("one") != F.col("two"))
    # Of the keys that two classes share, they are a pair under the first.
    once = F.get(F.array_intersect("left_keys", "right_keys"), F.lit(0)) == F.col("key")
    met_again = left.repartition(n, "key", "block").join(right.repartition(n, "met", "part"), apart & may_be_similar("left", "right") & once)
    return met_again.select("a", "b").distinct()


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): verified links between classes, as many as connect what is connected."""
    met = met_classes(classes)
    found = materialise(verified(materialise(candidates(met, classes), "copies-candidates"), rows), "copies-links")
    more = materialise(left_candidates(met, classes, found), "copies-left")
    return found.unionByName(verified(more, rows))


def verified(pairs: DataFrame, rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts are near duplicates."""
    needed = pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct()
    texts = materialise(rows.select(ROW, F.coalesce("text", F.lit("")).alias("text")).join(needed, ROW, "left_semi"), "copies-texts")
    left = texts.select(F.col(ROW).alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col(ROW).alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                sets = []
                for key, column in ((a, 2), (b, 3)):
                    own = known.get(key)
                    if own is None:
                        own = shingles(batch.column(column)[i].as_py())
                        if held > REMEMBERED:
                            known.clear()
                            held = 0
                        known[key] = own
                        held += len(own)
                    sets.append(own)
                x, y = sets
                if min(len(x), len(y)) + 1e-9 >= similar * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = shared + 1e-9 >= similar * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def survivors(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The row number of the document that stays of each group, of numbered documents; with ``among`` only the rows it numbers are looked at.

    Rows are left out by their sketches, which are a small part of the texts, so the texts themselves are not moved for it.
    """
    found = sketches(rows)
    if among is not None:
        found = found.join(among.select(F.col(ROW).alias("own_row")), F.col(f"name.{ROW}") == F.col("own_row"), "left_semi")
    found = materialise(found, "copies-sketches")
    classes = found.groupBy("n1", "n2").agg(F.min("name").alias("name"), F.first("bands").alias("bands"), F.first("own").alias("own"))
    classes = materialise(classes.select(F.col(f"name.{ROW}").alias("node"), "name", "bands", "own"), "copies-classes")
    linked = materialise(links(classes, rows), "copies-all-links")
    groups = connected_components(linked, "copies-components").withColumnRenamed("node", "member")
    named = classes.join(groups, F.col("node") == F.col("member"), "left").groupBy(F.coalesce("component", "node")).agg(F.min("name").alias("name"))
    return materialise(named.select(F.col(f"name.{ROW}").alias(ROW)), "copies-kept")


@keeps_columns
def keep_one(documents: DataFrame, before: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents without near duplicates: of each group the row of the smallest id stays, with all its columns.

    Every row is a document of its own, whether its id is repeated or null; rows without an id come after the others. Documents
    without words, null text among them, are copies of each other. ``before`` gives, of numbered documents, the numbers of those that
    an earlier pass lets stay; the result is that of this pass over the other's, but documents are read through once for both.
    """
    rows = numbered(documents, "copies-rows")
    kept = survivors(rows, None if before is None else before(rows))
    return only_rows(rows, kept, "copies-gone").select(*documents.columns)
