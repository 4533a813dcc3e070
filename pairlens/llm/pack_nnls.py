"""Packing token sequences by non-negative least squares over the length histogram.

Documents become pieces of at most a window of tokens. How many pieces there are of each length is a histogram of at most one
number per length; combinations of few lengths that fill a window are enumerated, how often to use each is solved by
non-negative least squares against the histogram and rounded down, and what is left is packed greedily on the histogram. That
plan, bounded by the window and not by the corpus, is all the driver holds. Pieces are ranked within their length, spread over
salts so that a length that holds a third of all pieces stays spread, and a piece's rank names its sequence and offset.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.bpe_units import Remembered
from pairlens.llm.common import in_batches, key_and_text, tokenizer_file
from pairlens.session import materialise

TOKENIZER = "byte_bpe_50k.json"
WINDOW = 2048
END = 1
#: Lengths from which combinations of three are made: the most frequent ones.
FREQUENT = 48
#: Salts of a length at least, and pieces of all lengths for each salt beyond: a length that holds all of them gives groups of this size.
SALTS = 256
PIECES = 50_000


@lru_cache(maxsize=2)
def library_ids(tokenizer: str) -> Remembered:
    """The tokenizers library over distinct units of texts; one per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file(tokenizer))
    own.no_truncation()
    own.no_padding()

    return Remembered(Joined(own).encode)


#: Units that are encoded as one text.
JOINED = 64


class Joined:
    """Ids of units, many units a call: those that begin with a space may be joined, and the bytes of ids tell where each one ends."""

    def __init__(self, own) -> None:
        self.own = own
        added = own.get_added_tokens_decoder()
        names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
        # A character of a byte-level token stands for a byte.
        self.sizes = np.array([len(added[i].content.encode()) if i in added else len(n) for i, n in enumerate(names)], np.int64)

    def alone(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, units: list[str]) -> list[bytes]:
        out: list = [None] * len(units)
        fit = [i for i, u in enumerate(units) if len(u) > 1 and u[0] == " " and not u[1].isspace()]
        groups = [fit[i : i + JOINED] for i in range(0, len(fit), JOINED)]
        whole = self.own.encode_batch_fast(["".join([units[i] for i in group]) for group in groups], add_special_tokens=False)
        for group, encoded in zip(groups, whole, strict=True):
            ids = np.array(encoded.ids, "<u4")
            ends = np.cumsum([len(units[i].encode()) for i in group])
            reached = np.cumsum(self.sizes[ids])
            at = np.searchsorted(reached, ends)
            if len(reached) and at[-1] < len(reached) and (reached[at] == ends).all():
                held, places = ids.tobytes(), (4 * (at + 1)).tolist()
                for i, begin, end in zip(group, [0, *places], places, strict=False):
                    out[i] = held[begin:end]
        rest = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(rest, self.alone([units[i] for i in rest]), strict=True):
            out[i] = found
        return out


def cuts(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then half a window if more than that is left, then the rest.

    No piece but a whole window is longer than half of one, so any two of them fit together.
    """
    whole, rest = total - total % window, total % window
    half = window // 2 if rest > window // 2 > 0 else 0
    return [(s, window) for s in range(0, whole, window)] + [(whole + s, n) for s, n in ((0, half), (half, rest - half)) if n]


def pieces(documents: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end: int = END, keep: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): a document's ids with the end id, cut by ``cuts``.

    With ``keep`` a Python worker remembers units from task to task, which takes fewer calls; without, it holds none of them once a
    task is over, as workers outlive the stage and their memory is then others'.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        for keys, texts in in_batches(batches):
            made: list[list] = [[] for _ in schema]
            for key, own in zip(keys, library_ids(tokenizer).ids(texts), strict=True):
                whole = memoryview(own + last)
                total = len(whole) // 4
                for start, length in cuts(total, window):
                    part = whole[4 * start : 4 * (start + length)]
                    for column, value in zip(made, (key, start, length, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], schema=schema)
        if not keep:
            library_ids(tokenizer).known.clear()

    return key_and_text(documents).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(counts: np.ndarray, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill the window: it alone, pairs, and triples from two frequent lengths.

    ``counts[n]`` is the number of pieces of length n, 0 to the window. There are at most window + frequent^2 of them.
    """
    window = len(counts) - 1
    there = counts > 0
    found = [(window,)] if there[window] else []
    found += [(a, window - a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    often = sorted(np.argsort(-counts[:window], kind="stable")[:frequent].tolist())
    often = [n for n in often if n and there[n]]
    triples = {tuple(sorted((a, b, window - a - b))) for a in often for b in often if window - a - b > 0 and there[window - a - b]}
    return found + sorted(triples)


def solve(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares, min ||A x - counts||, A's columns being how often a combination uses each length.

    Coordinate descent with projection: each step is the exact minimum over one repeat count, at least zero.
    """
    x = np.zeros(len(columns))
    rest = counts.astype(float)
    uses = [tuple((n, c.count(n)) for n in sorted(set(c))) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, use in enumerate(uses):
            step = max(sum(m * rest[n] for n, m in use) / sum(m * m for _, m in use), -x[k])
            if step:
                x[k] += step
                for n, m in use:
                    rest[n] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


@dataclass(frozen=True)
class Plan:
    """Slots by length and first rank: rank r of a length falls into the slot with the last ``first`` not above it."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray


def plan(counts: np.ndarray) -> Plan:
    """Sequences for a histogram: solved combinations, rounded down to what is there, then greedy fills of the rest."""
    window = len(counts) - 1
    left = counts.astype(np.int64).copy()
    slots, used, sequence = [], np.zeros(window + 1, np.int64), 0

    def put(pattern: dict[int, int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for n, times in pattern.items():
            slots.append((n, used[n], sequence, times, offset))
            used[n] += times * repeats
            left[n] -= times * repeats
            offset += n * times
        sequence += repeats

    columns = combinations(left)
    for column, value in zip(columns, solve(columns, left), strict=True):
        pattern = {n: column.count(n) for n in sorted(set(column), reverse=True)}
        repeats = min([int(value + 1e-9), *(int(left[n]) // m for n, m in pattern.items())])
        if repeats > 0:
            put(pattern, repeats)
    while left.any():
        # The longest piece, then always the longest that still fits; each pattern uses up one length at least.
        pattern: dict[int, int] = {}
        room = window
        lengths = np.flatnonzero(left)
        while room:
            at = np.searchsorted(lengths, room, side="right") - 1
            if at < 0:
                break
            n = int(lengths[at])
            times = min(room // n, int(left[n])) if pattern else 1
            pattern[n] = times
            room -= n * times
            lengths = lengths[:at] if len(pattern) > 1 or left[n] == 1 or n > room else lengths[: at + 1]
            if len(pattern) == 1 and n <= room and left[n] > 1:
                times = min(room // n, int(left[n]) - 1)
                pattern[n] += times
                room -= n * times
                lengths = lengths[:at]
        put(pattern, min(int(left[n]) // m for n, m in pattern.items()))
    slots.sort()
    columns_ = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*columns_)


def place(own: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given by length and rank within it."""
    most = int(own.first.max(initial=0)) + int(rank.max(initial=0)) + 2
    wide = own.length.astype(object) * most + own.first if most > (1 << 50) else own.length * most + own.first
    asked = length.astype(object) * most + rank if most > (1 << 50) else length * most + rank
    at = np.searchsorted(wide, asked, side="right") - 1
    over = rank - own.first[at]
    return own.sequence[at] + over // own.times[at], own.offset[at] + over % own.times[at] * length


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, salts: int = SALTS, keep: bool = True) -> DataFrame:
    """The pieces with sequence_id and offset: gapless from 0 in each sequence, no sequence longer than the window.

    Null text is empty and gives the end id alone; repeated rows give pieces of their own; an empty table gives no rows.
    Pieces that agree in all columns are interchangeable, so nothing depends on their order.
    ``keep`` is as for ``pieces``.
    """
    found = materialise(pieces(documents, window, tokenizer, keep=keep), "pack-pieces")
    salts = max(salts, -(-found.count() // PIECES))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).alias("salt")
    groups = materialise(found.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n")), "pack-histogram")
    counts = np.zeros(window + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[row["length"]] = row["n"]
    own = plan(counts)
    ordered = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def placed(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = place(own, length, rank)
            arrays = [batch.column(i) for i in range(5)] + [pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(placed, schema)
