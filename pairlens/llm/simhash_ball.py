"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a word within ``radius / 2`` bits of both. So every distinct
fingerprint emits all words within half the radius (itself and 64 neighbours for a radius of 2), the words are shuffled, and
whoever meets under a word is a candidate. All fingerprints of one word are within the radius of each other, so a word with
g fingerprints yields g - 1 links to its smallest one and no pair is lost from the components; exact links, where they are
asked for, are counted apart.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import ROW, keeps_columns, key_and_text, map_texts, numbered, only_rows
from pairlens.llm.components import connected_components
from pairlens.session import materialise

SEED = 42
BITS = 64
RADIUS = 2
WORDS = 3


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    import xxhash

    # On UTF-8 bytes lower() touches A-Z alone and split() cuts at space and 09-0D alone.
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = min(words, len(found))
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(found) - size + 1
    cuts = map(slice, starts[:n].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        octets = hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null text counts as empty, whose fingerprint is zero."""

    def rows(keys: list, texts: list[str]) -> dict[str, list]:
        found = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
        return {"doc_id": keys, "fp": found.view(np.int64)}

    return map_texts(key_and_text(documents), rows, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of all words with at most ``radius`` bits, as signed longs: 1 and 64 for one bit, growing as 64^radius."""
    masks, last = [0], [0]
    for _ in range(radius):
        last = sorted({m | 1 << i for m in last for i in range(BITS) if not m >> i & 1})
        masks += last
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough of them to connect all that are within ``radius``.

    ``distinct`` has one row per fingerprint. Fingerprints under one word differ in at most twice the half radius, so
    linking each with the smallest of its word keeps every component whole; there are fewer links than emitted rows.
    """
    if radius % 2:
        raise ValueError("the radius has to be even to be halved")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    words = distinct.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("word"))
    # One shuffle of 16-byte rows; a word has at most 65 distinct fingerprints at a radius of 2, so no window is large.
    least = F.min("fp").over(Window.partitionBy("word"))
    met = words.select(least.alias("a"), F.col("fp").alias("b")).filter("a <> b").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the smallest doc_id reachable over links, itself included.

    Copies have one fingerprint and are reduced to it before anything is emitted; documents without words share the
    fingerprint zero and are linked like any other. Repeated ids give a row each, a null id never names a component
    unless all ids of the component are null. An empty table gives an empty result.
    """
    stored = materialise(fingerprints(documents, words), "simhash-fingerprints")
    distinct = stored.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    found = connected_components(links(distinct.select("fp"), radius), "simhash-components")
    # A component's name in document ids: the smallest of its fingerprints' smallest ids.
    root = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        distinct["fp"], "first_doc", F.coalesce("component", "fp").alias("root")
    )
    named = root.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    names = root.join(named, "root").select("fp", "component_id")
    return stored.join(names, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def survivors(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row number of the document that stays of each component, of numbered documents."""
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), radius).select(F.col("doc_id").alias(ROW), "component_id")
    named = rows.select(ROW, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW).alias("name"))
    kept = found.join(named, ROW).groupBy("component_id").agg(F.min("name").alias("name")).select(F.col(f"name.{ROW}").alias(ROW))
    return materialise(kept, "simhash-kept")


@keeps_columns
def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near duplicates: of each component, the document of the smallest id stays, with all its columns.

    Every row is a document of its own, whether its id is repeated or null; rows without an id come after the others.
    """
    rows = numbered(documents, "simhash-rows")
    return only_rows(rows, survivors(rows, radius), "simhash-gone").select(*documents.columns)
