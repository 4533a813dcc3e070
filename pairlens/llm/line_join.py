"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``edits`` edits, cut into ``edits + 1`` segments each, share a segment: a line of n bytes is indexed under its
segments, and a line probes, for every length it may be linked with, the substrings at which such a segment can lie when the
edits before and behind it are shared out. Keys carry length, segment number and bytes, so only lines of fitting length and
place meet. Who meets is held against a byte-parity signature within the join, so that lines that merely share a segment
(a template, a passage) never become pairs, and is then verified by a banded bit-parallel edit distance, many pairs at a time.

Edits are counted on UTF-8 bytes. What a pair is allowed depends on its shorter line: all edits from ``least`` bytes on, one from
``SHORTEST`` on, none below, as a word of few letters is within an edit of many others. Equal lines are one line of the join,
however often they occur and whatever their length; lines without a word are compared from ``least`` bytes on only.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import ROW, in_batches, keeps_columns, key_and_text, numbered
from pairlens.session import bounded_batches, materialise

EDITS = 2
LEAST = 20
#: Bytes from which a line under LEAST is linked with those within one edit of a byte.
SHORTEST = 10
#: Characters from which a line under LEAST bytes is linked with those within one edit, where short lines are compared.
SHORT = 10
#: Pairs verified together hold about this many bytes.
PAIR_BYTES = 4_000_000
#: Lines of which a task remembers that their keys are out; only repeats are saved by it.
REMEMBERED = 200_000
#: Rows under one key beyond which the key is split by blocks of the signature.
HOT = 2000

#: Bits of the filter that spares lines without a candidate from being shuffled; fixed, so it never grows with the data.
FILTER_BITS = 1 << 23

#: One of 32 parity bits per byte value.
PARITY = np.left_shift(np.uint32(1), (np.arange(256, dtype=np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(27))


def segments(size: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of even segments, the longer ones last."""
    short, longer = divmod(size, parts)
    cuts = [i * short + max(0, i - (parts - longer)) for i in range(parts)] + [size]
    return list(zip(cuts, cuts[1:], strict=False))


def allowed(size: int, edits: int, least: int, shortest: int) -> int:
    """Edits between a line of ``size`` bytes and one that is no shorter."""
    return edits if size >= least else min(edits, 1) if size >= shortest else 0


def probe_places(size: int, edits: int, least: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """(other line's size, segment, start, end): where a line of ``size`` looks for segments of equal or shorter lines.

    Segment i of the other line has i segments before it. If it is the first one without an edit, at most i edits lie before
    it and at most the rest behind it, which bounds how far it can have moved from either end.
    """
    found = []
    for shorter in range(min(edits, size - shortest) + 1):
        reach = allowed(size - shorter, edits, least, shortest)
        if shorter > reach:
            continue
        for i, (at, end) in enumerate(segments(size - shorter, reach + 1)):
            low = max(0, at - i, at + shorter - (reach - i))
            high = min(at + i, at + shorter + (reach - i), size - (end - at))
            found += [(size - shorter, i, s, s + end - at) for s in range(low, high + 1)]
    return found


def parities(lines: list[bytes]) -> np.ndarray:
    """32 parity bits of each non-empty line's bytes; an edit changes two of them at most."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.bitwise_xor.reduceat(PARITY[np.frombuffer(b"".join(lines), np.uint8)], np.cumsum(sizes) - sizes)


def identify(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a line, as two longs; the low half of the first is its parity signature."""
    import xxhash

    wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">u8").astype(np.uint64).reshape(-1, 2)
    first = wide[:, 0] & np.uint64(0xFFFFFFFF00000000) | parities(lines).astype(np.uint64)
    return first.view(np.int64), np.ascontiguousarray(wide[:, 1]).view(np.int64)


def _long_lines(texts: list[str], least: int) -> list[bytes]:
    return [line for text in texts for line in text.encode().split(b"\n") if len(line) >= least]


def occurrences(documents: DataFrame, least: int = LEAST, short: bool = False) -> DataFrame:
    """(doc_id, line_no, n_bytes, h1, h2): every line of every document, from 0; h1 and h2 are null for short lines,
    with ``short`` only for those without a word.

    Where documents are numbered, doc_id is a struct of it and the number.
    """
    held, kind, key = key_and_text(documents), "long", pa.int64()
    if ROW in documents.columns:
        held = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), ROW), F.coalesce("text", F.lit("")))
        kind, key = f"struct<doc_id: long, {ROW}: long>", pa.struct([("doc_id", pa.int64()), (ROW, pa.int64())])
    schema = pa.schema([("doc_id", key), ("line_no", pa.int32()), ("n_bytes", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in in_batches(batches):
            split = [t.encode().split(b"\n") for t in texts]
            lines = [line for own in split for line in own]
            sizes = np.fromiter(map(len, lines), np.int32, len(lines))
            long = np.fromiter((bool(line.strip()) or len(line) >= least for line in lines), bool, len(lines)) if short else sizes >= least
            h1, h2 = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
            if long.any():
                h1[long], h2[long] = identify([line for line, is_long in zip(lines, long, strict=True) if is_long])
            counts = [len(own) for own in split]
            ids = pa.array(keys, key).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
            numbers = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(numbers), pa.array(sizes), pa.array(h1, mask=~long), pa.array(h2, mask=~long)], schema=schema
            )

    return held.mapInArrow(run, f"doc_id {kind}, line_no int, n_bytes int, h1 long, h2 long")


def keys(documents: DataFrame, edits: int, least: int, shortest: int, probes: bool) -> DataFrame:
    """(key, h1, reach): a row for every key a line is indexed under or, with ``probes``, looks up; ``reach`` is the number of
    edits allowed there, negative where it looks for shorter lines.
    """
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("reach", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        done: set[int] = set()
        plans: dict[int, list[tuple[int, int, int, int]]] = {}
        for _, texts in in_batches(batches, 1_000_000):
            found = _long_lines(texts, shortest)
            if not found:
                continue
            made, owners, reach = [], [], []
            for line, h in zip(found, identify(found)[0].tolist(), strict=True):
                if h in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(h)
                size = len(line)
                plan = plans.get(size)
                if plan is None:
                    bound = allowed(size, edits, least, shortest)
                    places = [(size, i, s, e) for i, (s, e) in enumerate(segments(size, bound + 1))]
                    if probes:  # its own segments are among them
                        places = probe_places(size, edits, least, shortest)
                    plan = []
                    for other, i, s, e in places:
                        bound = allowed(other, edits, least, shortest)
                        plan.append((s, e, other * 64 + i, -bound if other < size else bound))
                    if len(plans) > 20_000:
                        plans.clear()
                    plans[size] = plan
                made += [digest(line[s:e], seed) for s, e, seed, _ in plan]
                reach += [bound for *_, bound in plan]
                owners += [h] * len(plan)
            if made:
                arrays = [np.array(made, np.uint64).view(np.int64), np.array(owners, np.int64), np.array(reach, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)

    return key_and_text(documents).mapInArrow(run, "key long, h1 long, reach int")


def candidates(documents: DataFrame, edits: int = EDITS, least: int = LEAST, shortest: int = LEAST) -> DataFrame:
    """(a, b): names (first halves) of lines that share a key and whose signatures allow the edits of the pair.

    The signatures are compared inside the join, which Spark splits when a key is skewed. A key with more than ``HOT``
    indexed rows is replaced by finer ones: two signatures within 2 * edits bits agree in one of 2 * edits + 1 blocks, so
    each row of such a key meets others under its blocks and no link is lost.
    """
    index = materialise(keys(documents, edits, least, shortest, probes=False).select("key", "h1"), "line-index")
    probes = keys(documents, edits, least, shortest, probes=True)
    blocks = 2 * edits + 1
    heavy = materialise(index.groupBy("key").count().filter(F.col("count") > HOT).select(F.col("key").alias("heavy")), "line-hot-keys")
    if not heavy.isEmpty():
        finer = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.xxhash64("key", i, _block("h1", i, blocks)))
        split = F.when(F.col("heavy").isNull(), F.array("key")).otherwise(finer)

        def divided(rows: DataFrame) -> DataFrame:
            rest = [c for c in rows.columns if c != "key"]
            return rows.join(heavy, rows["key"] == heavy["heavy"], "left").select(F.explode(split).alias("key"), *rest)

        index, probes = divided(index), divided(probes)
    index = index.select("key", F.col("h1").alias("a"))
    probes = probes.select(F.col("key").alias("probed"), F.col("h1").alias("b"), "reach")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(0xFFFFFFFF)))
    # Of two lines of one length either finds the other, so only the one with the greater name looks.
    once = (F.col("a") < F.col("b")) | ((F.col("reach") < 0) & (F.col("a") != F.col("b")))
    met = index.join(probes, (F.col("key") == F.col("probed")) & once & (differ <= 2 * F.abs("reach")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block(name: str, i: Column, blocks: int) -> Column:
    """Block i of the 32 signature bits."""
    width = -(-32 // blocks)
    return F.call_function("mod", F.call_function("shiftrightunsigned", F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), i * width), F.lit(1 << width))


def within(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    """Whether each pair is within ``edits`` edits, by a bit-parallel band, one word per pair.

    The word covers the diagonals around the main one, its highest bit the lowest row of the band. The cost is followed down
    that border to the last row and from there along it. A common beginning changes no distance, so both lines are given
    one, and the band starts inside the table whatever the lengths.
    """
    if edits > 30:
        raise ValueError("the band has to fit into one word")
    head = b"\0" * (edits + 1)
    sizes = [(len(x), len(y)) for x, y in zip(left, right, strict=True)]
    result = np.zeros(len(left), bool)
    order = sorted((i for i, (x, y) in enumerate(sizes) if abs(x - y) <= edits), key=lambda i: -sizes[i][1])
    if not order:
        return result
    rows = np.array([sizes[i][0] + len(head) for i in order])
    columns = np.array([sizes[i][1] + len(head) for i in order])
    # Bytes that UTF-8 never has stand beyond the ends, different ones on either side.
    across = _padded([head + right[i] for i in order], 0, int(columns[0]), 0xFE)
    down = _padded([head + left[i] for i in order], edits, int(columns[0]) + 2 * edits + 1, 0xFF)
    n = len(order)
    plus = np.full(n, (1 << 64) - (1 << (63 - edits)), np.uint64)
    minus = np.zeros(n, np.uint64)
    cost = np.full(n, edits, np.int64)
    one, top = np.uint64(1), np.uint64(63)
    alive = n
    for j in range(int(columns[0])):
        while alive and columns[alive - 1] <= j:
            alive -= 1
        p, m = plus[:alive], minus[:alive]
        same = np.zeros(alive, np.uint64)
        for d in range(2 * edits + 1):
            same |= (down[j + d, :alive] == across[j, :alive]).astype(np.uint64) << np.uint64(63 - 2 * edits + d)
        diagonal = (((same & p) + p) ^ p) | same | m
        right_up, right_down = m | ~(diagonal | p), diagonal & p
        # Rows below the last are those by which the border has left the table.
        below = j + 1 + edits - rows[:alive]
        on_border = below <= 0
        bit = (top - np.maximum(below, 0).astype(np.uint64)).astype(np.uint64)
        sideways = (right_up >> bit & one).astype(np.int64) - (right_down >> bit & one).astype(np.int64)
        cost[:alive] += np.where(on_border, 1 - (diagonal >> top & one).astype(np.int64), sideways)
        moved = diagonal >> one
        plus[:alive], minus[:alive] = right_down | ~(moved | right_up), moved & right_up
    result[np.array(order)] = cost <= edits
    return result


def _linked(left: list[bytes], right: list[bytes], edits: int, least: int, shortest: int) -> np.ndarray:
    """Whether each pair is within the edits that its shorter line allows."""
    good = within(left, right, edits)
    bounds = np.array([allowed(min(len(x), len(y)), edits, least, shortest) for x, y in zip(left, right, strict=True)])
    for bound in np.unique(bounds[good & (bounds < edits)]):
        some = np.flatnonzero(good & (bounds == bound))
        good[some] = within([left[i] for i in some], [right[i] for i in some], int(bound))
    return good


def _padded(lines: list[bytes], before: int, width: int, fill: int) -> np.ndarray:
    """Bytes of the lines as columns, with ``fill`` around them."""
    table = np.full((len(lines), max(width, before + max(map(len, lines)))), fill, np.uint8)
    for i, line in enumerate(lines):
        table[i, before : before + len(line)] = np.frombuffer(line, np.uint8)
    return np.ascontiguousarray(table.T)


def name_filter(names: DataFrame) -> np.ndarray:
    """A bit for every name (h1), by its hashed half: 64-bit words, as many as the filter has whatever the number of names.

    More names than bits leave it full, which costs the saving and no result, since an exact join follows.
    """
    bit = F.call_function("shiftrightunsigned", F.col("h1"), F.lit(32)).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = names.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits"))
    found = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # at most FILTER_BITS / 64 rows
        found[row["word"]] = row["bits"]
    return found.view(np.uint64)


def may_hold(bits: np.ndarray, h1: np.ndarray) -> np.ndarray:
    bit = h1.view(np.uint64) >> np.uint64(32) & np.uint64(FILTER_BITS - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def links(documents: DataFrame, edits: int = EDITS, least: int = LEAST, shortest: int = LEAST) -> DataFrame:
    """(a1, a2, b1, b2): every unordered pair of different lines within the edits allowed to it, by their 128-bit names."""
    pairs = materialise(candidates(documents, edits, least, shortest), "line-candidates")
    needed = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
    needed = materialise(needed, "line-needed")
    bits = name_filter(needed)
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("line", pa.binary())])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in in_batches(batches):
            found = list(dict.fromkeys(_long_lines(texts, shortest)))
            if not found:
                continue
            h1, h2 = identify(found)
            may = np.flatnonzero(may_hold(bits, h1))
            if len(may):
                lines = pa.array([found[i] for i in may], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h1[may]), pa.array(h2[may]), lines], schema=schema)

    lines = key_and_text(documents).mapInArrow(texts_of, "h1 long, h2 long, line binary").join(needed, "h1", "left_semi")
    lines = materialise(lines.dropDuplicates(["h1", "h2"]), "line-texts")
    left = lines.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("left"))
    right = lines.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "left", "right")
    out = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin = 0, 0
            widths = np.array([len(x) for x in batch.column(4).to_pylist()], np.int64)
            for end in range(1, batch.num_rows + 1):
                size += int(widths[end - 1])
                if size >= PAIR_BYTES or end == batch.num_rows:
                    part = batch.slice(begin, end - begin)
                    good = _linked(part.column(4).to_pylist(), part.column(5).to_pylist(), edits, least, shortest)
                    yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good)) for i in range(4)], schema=out)
                    begin, size = end, 0

    return both.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long")


def _linked_classes(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """(h1, h2, n_links, earliest): how many classes each linked class is linked with, and where the first of them begins."""
    turned = linked.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    other = classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("other"))
    return (
        linked.unionByName(turned)
        .join(other, ["b1", "b2"])
        .groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("earliest"))
    )


def line_classes(documents: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = True) -> DataFrame:
    """Per line: doc_id, line_no, n_bytes, first_doc_id, first_line_no (where its class, the equal lines, is first met),
    n_links (other classes within the edits allowed) and kept.

    A line goes if an earlier line, by document id and line number, is equal to it or linked with its class by one whose
    class begins earlier. Lines under ``least`` bytes without a word stay, without ``short`` all lines under it. A document without
    text has one empty line. A null id comes before others. Rows that repeat an id are lines of the same places, of which each
    row's copy is first.
    """
    bounded_batches(documents.sparkSession)
    found = materialise(occurrences(documents, least, short), "line-occurrences")
    place = F.struct(F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"))
    classes = found.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "line-classes")
    linked = materialise(links(documents, edits, least, min(least, SHORTEST) if short else least), "line-links")
    per_class = _linked_classes(linked, classes)
    # Lines that occur once and are linked with nothing need no look-up.
    known = classes.join(per_class, ["h1", "h2"], "left").filter("n > 1 OR n_links IS NOT NULL")
    known = known.select("h1", "h2", "first", "n_links", "earliest")
    own = F.struct("doc_id", "line_no")
    return found.join(known, ["h1", "h2"], "left").select(
        "doc_id",
        "line_no",
        "n_bytes",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.first_doc_id")).alias("first_doc_id"),
        F.coalesce("first.first_line_no", "line_no").alias("first_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("first").isNull() | ((own == F.col("first")) & (F.col("earliest").isNull() | (F.col("first") < F.col("earliest"))))).alias("kept"),
    )


def short_keys(rows: DataFrame, least: int) -> DataFrame:
    """(h1, h2, is_short, k1, k2, own, cut): keys under which lines of up to ``least`` bytes and a character meet if one edit of a
    character makes them equal.

    A line with its character i replaced by a gap meets those that differ in it alone (own and cut); a line as it is (own)
    meets those from which one character was taken out (cut).
    """
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "h2")] + [("is_short", pa.bool_())] + [(c, pa.int64()) for c in ("k1", "k2")] + [(c, pa.bool_()) for c in ("own", "cut")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        done: set[bytes] = set()
        for _, texts in in_batches(batches, 1_000_000):
            fit = dict.fromkeys(line for text in texts for line in text.split("\n") if SHORT <= len(line) <= least)
            found = {b: line for line in fit if len(b := line.encode()) < least + 4 and b.strip() and b not in done}
            if len(done) >= REMEMBERED:
                done.clear()
            done.update(found)
            owners, made, flags = [], [], []
            for i, (held, line) in enumerate(found.items()):
                gaps = [(f"{at}:{line[:at]}\n{line[at + 1:]}", True, True) for at in range(len(line))]
                cuts = [(f"-:{t}", False, True) for t in {line[:at] + line[at + 1 :] for at in range(len(line))} if len(t) >= SHORT]
                for key, own, cut in [(f"-:{line}", True, False), *gaps, *cuts]:
                    owners.append(i)
                    made.append(xxhash.xxh3_128_digest(key.encode()))
                    flags.append((len(held) < least, own, cut))
            if made:
                h1, h2 = identify(list(found))
                wide = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
                is_short, own, cut = np.array(flags, bool).T
                at = np.array(owners)
                columns = (h1[at], h2[at], is_short, wide[:, 0], wide[:, 1], own, cut)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=schema)

    return key_and_text(rows).mapInArrow(run, "h1 long, h2 long, is_short boolean, k1 long, k2 long, own boolean, cut boolean")


def _short_links(rows: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(h1, h2, earliest): where the first line begins, the line itself included, that is within one edit and has a short line on either side.

    Under a key only the first places are held, never pairs, so it takes one row a task however many lines meet there.
    """
    made = short_keys(rows, least).distinct().join(classes.select("h1", "h2", "first"), ["h1", "h2"])
    made = materialise(made, "line-short-keys")
    sides = {f"{side}_{kind}": F.min(F.when(F.col(side) & F.col(kind), F.col("first"))) for side in ("own", "cut") for kind in ("is_short", "any")}
    met = made.withColumn("any", F.lit(True)).groupBy("k1", "k2").agg(*[held.alias(name) for name, held in sides.items()], F.count(F.lit(1)).alias("n"))
    own, cut = (F.when(F.col("is_short"), F.col(f"{side}_any")).otherwise(F.col(f"{side}_is_short")) for side in ("own", "cut"))
    seen = made.join(met.filter("n > 1"), ["k1", "k2"]).select("h1", "h2", F.when(F.col("own"), cut).alias("x"), F.when(F.col("cut"), own).alias("y"))
    return seen.groupBy("h1", "h2").agg(F.least(F.min("x"), F.min("y")).alias("earliest"))


@keeps_columns
def drop_repeated_lines(documents: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """The documents, all of them and with their columns, without the lines that repeat an earlier one as ``line_classes`` has it.

    Every row is a document of its own, whether its id is repeated or null: of rows with one id, the line of the first one stays.
    With ``short`` the lines under ``least`` bytes are compared as well, but for those without a word: equal ones of any length are one
    line, and from ``SHORT`` characters on they are linked with lines within one edit of a character.
    """
    rows = numbered(documents, "line-rows")
    gone = _repeated(rows, edits, least, short).groupBy(F.col(ROW).alias("__gone_row")).agg(F.collect_set("line_no").alias("__gone"))
    met = rows.join(gone, rows[ROW] == gone["__gone_row"], "left")
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    made = {"text": text} | ({"n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in documents.columns else {})
    return met.select(*[made.get(c, rows[c]).alias(c) for c in documents.columns])


def _repeated(rows: DataFrame, edits: int, least: int, short: bool) -> DataFrame:
    """(row, line_no) of the lines of numbered documents that go; places are ordered by document id, row and line."""
    found = occurrences(rows, least, short).filter("h1 IS NOT NULL")
    found = materialise(found.select(F.struct("doc_id.*", "line_no").alias("place"), "h1", "h2"), "line-occurrences")
    classes = found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "line-classes")
    near = _linked_classes(materialise(links(rows, edits, least), "line-links"), classes).select("h1", "h2", "earliest")
    if short:
        near = near.unionByName(_short_links(rows, classes, least)).groupBy("h1", "h2").agg(F.min("earliest").alias("earliest"))
    known = classes.join(near, ["h1", "h2"], "left").filter("n > 1 OR earliest < first").select("h1", "h2", "first", "earliest")
    goes = (F.col("place") != F.col("first")) | F.coalesce(F.col("earliest") < F.col("first"), F.lit(False))
    return found.join(known, ["h1", "h2"]).filter(goes).select(f"place.{ROW}", "place.line_no")
