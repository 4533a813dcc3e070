"""Collocations of up to four words per language, mined level by level with double-array tries.

Texts are cut into words once and kept as blocks: the distinct words of some texts of a language, their counts, and the texts as
numbers of these words with breaks between pieces. Frequent words get global numbers, which replace the blocks' own.

Level k knows the frequent phrases of k-1 words. They are put into double-array tries (base, check) of bounded size, one for each
shard of the phrases, and each trie is broadcast for a pass over the blocks. All positions of a block start at the root and are
advanced together, one word a step; those that reach an accepting state, and are followed by a frequent word (and by a state
of the same trie for the phrase that begins one word later, where the trie holds all), are Apriori-safe. The candidates of
level k are the safe pairs (state, next word) that texts have: to list all that could be would take the square of the
vocabulary. Each task bincounts its candidates, the shards' and tasks' counts are summed, and what is frequent is the next level.

Nothing grows with the data but tables: tries have ``STATES`` phrases at most, and the words a driver holds to number them have
a bound too, beyond which blocks and words are joined.

Defined cases: null text is empty, null lang is ``und``; repeated rows count each time; a document of one piece or one word, or an
empty table, gives what it has. Extra columns never reach the operator.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import in_batches
from pairlens.session import materialise

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
#: A candidate goes if a longer one that holds it has this many hundredths of its occurrences.
HELD = 80
TOP = 2000
#: Phrases in a trie, and frequent words up to which their numbers are broadcast.
STATES = 1_000_000
VOCABULARY = 2_000_000
#: Characters of a block.
BLOCK_CHARS = 4_000_000
#: Words whose states are advanced together.
WORDS = 250_000
#: Candidates that a task sums before it gives them out, and rows of a batch in which it does.
SUMMED = 400_000
GIVEN = 100_000

#: Bits of a digit, children that a state can have, and children up to which states share rows of the array.
BITS = 6
FAN = 1 << BITS
FEW = 8

UNKNOWN = "und"
BREAK = b"\xff"
#: Bytes that end a piece become a break, which UTF-8 never has; A-Z are lower-cased.
BYTES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text with a break between pieces and at the end; no other white space than blank and tab is left to split at."""
    return text.encode().translate(BYTES).replace(BREAK, b" \xff ").split() + [BREAK]


def blocks(documents: DataFrame) -> DataFrame:
    """(lang, words, counts, codes): blocks of texts; codes are places in ``words`` as 32-bit integers, -1 for a break."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in in_batches(batches, BLOCK_CHARS):
            held: dict[str, tuple[dict[bytes, int], list[int]]] = {}
            for lang, text in zip(langs, texts, strict=True):
                known, codes = held.setdefault(lang, ({BREAK: 0}, []))
                codes += [known.setdefault(w, len(known)) for w in words_of(text)]
            rows = []
            for lang, (known, codes) in held.items():
                places = np.array(codes, np.int32)
                names = pa.array(list(known)[1:], pa.binary()).cast(pa.string())
                rows.append((lang, names, np.bincount(places, minlength=len(known))[1:], (places - 1).tobytes()))
            columns = [
                pa.array([r[0] for r in rows], pa.string()),
                pa.ListArray.from_arrays(np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int32), pa.concat_arrays([r[1] for r in rows])),
                pa.ListArray.from_arrays(np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32), pa.array(np.concatenate([r[2] for r in rows]), pa.int64())),
                pa.array([r[3] for r in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "lang string, words array<string>, counts array<long>, codes binary")


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """(id, lang, phrase, f): the frequent words, numbered from 0 without gaps, in no order."""
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    found = each.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    # The number of a row in its partition, and of its partition: stored, so that they stay as they are.
    at = F.monotonically_increasing_id()
    stored = materialise(found.select(F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "lang", "phrase", "f"), "phrase-words")
    before, offsets = 0, []
    for row in stored.groupBy("part").count().collect():  # a row for each task of the aggregate
        offsets.append((row["part"], before))
        before += row["count"]
    starts = F.broadcast(stored.sparkSession.createDataFrame(offsets, "part long, start long"))
    return stored.join(starts, "part").select((F.col("start") + F.col("at")).alias("id"), "lang", "phrase", "f")


def number_type(n_words: int) -> str:
    """How the words of a text are stored: in four bytes as long as their numbers fit."""
    return "<i4" if n_words < 1 << 31 else "<i8"


def encoded(cut: DataFrame, words: DataFrame, n_words: int, most: int = VOCABULARY) -> DataFrame:
    """(ids): the blocks' texts as global numbers of frequent words, -1 for breaks and all other words."""
    kind = number_type(n_words)
    if n_words <= most:
        table = words.select("lang", "phrase", "id").toArrow().combine_chunks()  # at most VOCABULARY words
        known = {lang: table.filter(pc.equal(table["lang"], lang)).combine_chunks() for lang in table["lang"].unique().to_pylist()}
        known = {lang: (own["phrase"].combine_chunks(), own["id"].to_numpy()) for lang, own in known.items()}

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, own, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    names, numbers = known.get(lang, (None, None))
                    found = np.full(len(own.values), -1, np.int64)
                    if names is not None:
                        at = pc.fill_null(pc.index_in(own.values, value_set=names), -1).to_numpy(zero_copy_only=False)
                        found[at >= 0] = numbers[at[at >= 0]]
                    yield pa.RecordBatch.from_arrays([pa.array([_renumbered(codes.as_py(), found, kind)], pa.binary())], names=["ids"])

        return materialise(cut.select("lang", "words", "codes").mapInArrow(looked_up, "ids binary"), "phrase-encoded")
    kept = materialise(cut.select(F.monotonically_increasing_id().alias("block"), "lang", "words", "codes"), "phrase-blocks")
    each = kept.select("block", "lang", F.posexplode("words").alias("at", "phrase")).join(words.select("lang", "phrase", "id"), ["lang", "phrase"])
    # At most the distinct words of one block meet, which its size bounds.
    own = each.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("known"))
    met = kept.select("block", F.size("words").alias("n"), "codes").join(own, "block", "left").select("n", "codes", "known.at", "known.id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, codes, at, numbers in zip(*batch.columns, strict=True):
                own = np.full(n.as_py(), -1, np.int64)
                own[np.array(at.as_py() or [], np.int64)] = np.array(numbers.as_py() or [], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_renumbered(codes.as_py(), own, kind)], pa.binary())], names=["ids"])

    return materialise(met.mapInArrow(joined, "ids binary"), "phrase-encoded")


def _renumbered(codes: bytes, numbers: np.ndarray, kind: str) -> bytes:
    return np.append(numbers, -1).astype(kind)[np.frombuffer(codes, np.int32)].tobytes()


class DoubleArray:
    """A double-array trie over phrases of one length: a state's child by digit d is at base[state] + d if check there names the state.

    Words are taken as the digits of their place in the trie's alphabet, so no state has more than ``FAN`` children however many
    words follow a phrase. ``accepts`` gives the row of the phrase that ends in a state, -1 for inner ones.
    """

    def __init__(self, phrases: np.ndarray) -> None:
        """``phrases``: rows of global word numbers, all different."""
        self.alphabet = np.unique(phrases).astype(np.int64)
        n, self.depth = phrases.shape
        self.digits = max(1, -(-(len(self.alphabet) - 1).bit_length() // BITS)) if n else 1
        codes = np.searchsorted(self.alphabet, phrases)
        shifts = BITS * np.arange(self.digits - 1, -1, -1)
        steps = (codes[:, :, None] >> shifts & (FAN - 1)).reshape(n, self.depth * self.digits)
        order = np.lexsort(steps.T[::-1])
        steps = steps[order]
        self.base, self.check = np.full(1, -1, np.int64), np.full(1, -1, np.int64)
        state = np.zeros(n, np.int64)  # of each phrase's prefix so far; the root is 0
        first = np.zeros(n, bool)
        first[:1] = True
        rng = np.random.default_rng(7)
        for level in range(self.depth * self.digits if n else 0):
            first[1:] |= steps[1:, level] != steps[:-1, level]
            parents = state[first]
            places = self._placed(parents, steps[first, level], rng)
            self.check[places] = parents
            state = places[np.cumsum(first) - 1]
        self.accepts = np.full(len(self.base), -1, np.int64)
        self.accepts[state] = order

    def _placed(self, parents: np.ndarray, digits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Places for the children of each parent (those of one parent stand together), in room added for this level.

        Many children get a row of their own; a few are put where all their places are free, many parents at a time, so that
        rows overlap; an only child goes to any place that is left.
        """
        begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(begins, len(parents)))
        owner = np.repeat(np.arange(len(begins)), counts)
        base = np.full(len(begins), -1, np.int64)
        rows = np.flatnonzero(counts > FEW)
        base[rows] = FAN * np.arange(len(rows))
        shared = FAN * len(rows)
        few = (counts > 1) & (counts <= FEW)
        span = 4 * int(counts[few].sum()) + FAN
        room = max(shared + span + FAN, len(parents) + FAN)
        taken = np.zeros(room, bool)
        there = base[owner] >= 0
        taken[base[owner[there]] + digits[there]] = True
        open_ = few.copy()
        while open_.any():
            mine = np.flatnonzero(open_[owner])
            tries = shared + rng.integers(0, span, len(begins))
            spots = tries[owner[mine]] + digits[mine]
            wanted = np.bincount(spots, minlength=room)
            clash = np.bincount(owner[mine], weights=taken[spots] | (wanted[spots] > 1), minlength=len(begins)) > 0
            done = open_ & ~clash
            base[done] = tries[done]
            good = done[owner[mine]]
            taken[spots[good]] = True
            open_ &= ~done
        single = counts == 1
        left = np.flatnonzero(~taken)
        base[single] = left[: int(single.sum())] - digits[begins[single]]
        old = len(self.base)
        self.base = np.append(self.base, np.full(room, -1, np.int64))
        self.check = np.append(self.check, np.full(room, -1, np.int64))
        self.base[parents[begins]] = old + base
        return old + base[owner] + digits

    def advance(self, ids: np.ndarray) -> np.ndarray:
        """For each position the row of the phrase that begins there, -1 if none does: all positions go down together."""
        found = np.full(len(ids), -1, np.int64)
        if not len(self.alphabet):
            return found
        at = np.minimum(np.searchsorted(self.alphabet, ids), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == ids, at, -1)
        where = np.arange(max(0, len(ids) - self.depth + 1))
        state = np.zeros(len(where), np.int64)
        for step in range(self.depth):
            code = codes[where + step]
            there = code >= 0
            where, state, code = where[there], state[there], code[there]
            for digit in range(self.digits - 1, -1, -1):
                to = self.base[state] + (code >> BITS * digit & (FAN - 1))
                good = self.check[np.clip(to, 0, len(self.check) - 1)] == state
                good &= (to >= 0) & (to < len(self.check))
                where, state, code = where[good], to[good], code[good]
        found[where] = self.accepts[state]
        return found


def candidates_in(trie: DoubleArray, n_words: int, whole: bool, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, n): phrases of the trie with the frequent words that follow them, as phrase * n_words + word, and how often.

    ``whole``: the trie has all phrases of its length, so what follows must be accepted as well.
    """
    states = trie.advance(ids)
    last = np.append(ids[trie.depth :], np.full(min(trie.depth, len(ids)), -1, np.int64))
    safe = (states >= 0) & (last >= 0)
    if whole:
        safe &= np.append(states[1:], -1) >= 0
    return _summed(states[safe] * n_words + last[safe])


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands or what its counts add up to."""
    distinct, places = np.unique(keys, return_inverse=True)
    if counts is None:
        return distinct, np.bincount(places, minlength=len(distinct))
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, places, counts)
    return distinct, sums


def _some(batches: Iterator[pa.RecordBatch], kind: str, most: int = WORDS) -> Iterator[np.ndarray]:
    """The words of some blocks together, about ``most`` at a time."""
    held, size = [], 0
    for batch in batches:
        for ids in batch.column(0):
            held.append(np.frombuffer(ids.as_py(), kind))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def extended(texts: DataFrame, level: DataFrame, least: int, k: int, n_words: int, most: int = STATES) -> DataFrame:
    """(id, prefix, word, f): the frequent phrases of one word more than those of ``level`` (id, words), by prefix and last word."""
    kind = number_type(n_words)
    shards = max(1, -(-level.count() // max(1, most // 2)))  # shards by hash are uneven; half of the bound leaves room
    sums = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("prefix", pa.int64()), ("word", pa.int64()), ("f", pa.int64())])
    found = None
    for shard in range(shards):
        own = level.filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard) if shards > 1 else level
        table = own.select("id", "words").toArrow()  # about STATES / 2 phrases
        phrases = table["words"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, k - 1)
        trie, names, whole = DoubleArray(phrases), table["id"].to_numpy(), shards == 1

        def run(batches: Iterator[pa.RecordBatch], trie=trie, whole=whole) -> Iterator[pa.RecordBatch]:
            def given(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
                for i in range(0, len(keys), GIVEN):
                    columns = (keys[i : i + GIVEN], counts[i : i + GIVEN])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=sums)

            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for ids in _some(batches, kind):
                found, n = candidates_in(trie, n_words, whole, ids)
                keys, counts = _summed(np.append(keys, found), np.append(counts, n))
                if len(keys) >= SUMMED:
                    yield from given(keys, counts)
                    keys, counts = keys[:0], counts[:0]
            yield from given(keys, counts)

        def named(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy()
                columns = (names[keys // n_words], keys % n_words, batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        # A candidate is shuffled as one number; phrases of a shard are in no other, so each is summed alone.
        counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        part = counted.mapInArrow(named, "prefix long, word long, f long")
        found = part if found is None else found.unionByName(part)
    return materialise(found.select(F.monotonically_increasing_id().alias("id"), "prefix", "word", "f"), f"phrase-counts-{k}")


def levels(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, states: int = STATES, vocabulary: int = VOCABULARY) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases (id, lang, phrase, words, f) of 1 to ``longest`` words, and (lang, n), the words of each language."""
    cut = materialise(blocks(documents), "phrase-texts")
    totals = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = frequent_words(cut, least)
    n_words = words.count()
    texts = encoded(cut, words, n_words, vocabulary)
    found = [words.withColumn("words", F.array("id"))]
    for k in range(2, longest + 1):
        grown = extended(texts, found[-1], least, k, max(n_words, 1), states)
        head = found[-1].select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("words").alias("before"))
        tail = words.select(F.col("id").alias("word"), F.col("phrase").alias("tail"))
        named = grown.join(head, "prefix").join(tail, "word")
        phrase, own = F.concat_ws(" ", "head", "tail"), F.concat("before", F.array("word"))
        found.append(materialise(named.select("id", "lang", phrase.alias("phrase"), own.alias("words"), "f"), f"phrase-level-{k}"))
    return found, totals


def _div(dividend: Column, divisor: Column) -> Column:
    """Whole quotient of products that may pass 64 bits."""
    return F.call_function("div", dividend, divisor)


def _wide(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each phrase of two words or more at its lowest-scoring cut."""
    parts = found[0].select("words", "f")
    for level in found[1:-1]:
        parts = parts.unionByName(level.select("words", "f"))
    cuts = None
    for k, level in enumerate(found[1:], 2):
        for at in range(1, k):
            own = level.select("id", F.lit(k).alias("k"), F.lit(at).alias("at"), F.col("f").alias("a"), F.slice("words", 1, at).alias("head"), F.slice("words", at + 1, k - at).alias("tail"))
            cuts = own if cuts is None else cuts.unionByName(own)
    head, tail = parts.select(F.col("words").alias("head"), F.col("f").alias("l")), parts.select(F.col("words").alias("tail"), F.col("f").alias("r"))
    score = _div(_wide(F.lit(SCALE)) * _wide(F.col("a")), _wide(F.col("l")) + _wide(F.col("r"))).cast("long")
    met = cuts.join(head, "head").join(tail, "tail").select("k", "id", F.struct(score.alias("score"), "at", "l", "r").alias("cut"))
    least = met.groupBy("k", "id").agg(F.min("cut").alias("cut"))
    every = None
    for k, level in enumerate(found[1:], 2):
        own = level.select(F.lit(k).alias("k"), "id", "lang", "phrase", "words", F.col("f").alias("a"))
        every = own if every is None else every.unionByName(own)
    return every.join(least, ["k", "id"]).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outlived(rows: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Scored phrases that no longer one holds nearly as often; one that is itself dropped still counts."""
    inner = None
    for k, level in enumerate(found[2:], 3):
        spans = [F.slice("words", at + 1, size) for size in range(2, k) for at in range(k - size + 1)]
        own = level.select(F.explode(F.array(*spans)).alias("words"), "f")
        inner = own if inner is None else inner.unionByName(own)
    if inner is None:
        return rows
    most = inner.groupBy("words").agg(F.max("f").alias("longer"))
    held = _wide(F.lit(100)) * _wide(F.col("longer")) >= _wide(F.lit(HELD)) * _wide(F.col("a"))
    return rows.join(most, "words", "left").filter(~F.coalesce(held, F.lit(False))).drop("longer")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, occurrences and phrase."""
    found, totals = levels(documents, least, longest, **bounds)
    kept = materialise(outlived(scored(found), found), "phrase-scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
