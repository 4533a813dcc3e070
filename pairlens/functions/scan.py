"""Sentences scanned in Arrow batches: tokens, entities, mentions, near pairs and the places of given pairs.

What ``functions.text`` and the operators state as array expressions is worked out here for a whole batch: the word rules run as
vectorised kernels over all its texts, and a short loop places the names. Nested array lambdas are interpreted element by element
and cost several times as much. Texts with quotation marks, apostrophes or contractions take the rules one text at a time.
"""
from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.text import BAD_TOKENS, SPAN_WITH_CLOSE, STOP_WORDS, TAG

# The kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = r" \t\n\x0b\x0c\r"
#: Rules 1 to 3 of ``text.PTB_RULES``; without the characters of the others these are all that can fire. A final line end of another
#: kind than white space stays behind a closing period, as in the rule.
PLAIN_RULES = [
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([^.])\.([\])}>\"']*)[" + BLANK + r"]*([\x{85}\x{2028}\x{2029}]?)$", r"\1 . \2 \3"),
    (r"\.\.\.|--|[;@#$%&?!\[\](){}<>]", r" \0 "),
]
#: Characters and words for which the other rules are there.
OTHER_RULES = r"(?i)[\"']|cannot|gimme|gonna|gotta|lemme|wanna"

_END = r"(?=[\x85\u2028\u2029]?\Z)"
_LAST = (re.compile(r"([^.])\.([\])}>\"']*)[" + BLANK + "]*" + _END), r"\1 . \2 ")
_COLON, _SIGNS = (re.compile(r"([:,])([^0-9])"), r" \1 \2"), (re.compile(r"\.\.\.|--|[;@#$%&?!\[\](){}<>]"), r" \g<0> ")
_SPLIT_WORDS = [
    (re.compile(rf"\b({a})({b})\b"), r"\1 \2")
    for a, b in (("[cC][aA][nN]", "[nN][oO][tT]"), ("[gG][iI][mM]", "[mM][eE]"), ("[gG][oO][nN]", "[nN][aA]"),
                 ("[gG][oO][tT]", "[tT][aA]"), ("[lL][eE][mM]", "[mM][eE]"), ("[wW][aA][nN]", "[nN][aA]"))
]
_OPENING = (re.compile(r'(^|[ (\[{<])"'), r"\1 `` ")
_QUOTES = [
    (re.compile(r'"'), " '' "),
    (re.compile(rf"([^{BLANK}])''"), r"\1 '' "),
    (re.compile(r"([^' ])('[sSmMdD]|') "), r"\1 \2 "),
    (re.compile(r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) "), r"\1 \2 "),
]
_LATE = [
    (re.compile(r"\b(?:([dD])('[yY][eE])|([mM][oO][rR])('[nN]))\b"), lambda m: f"{m[1] or ''}{m[3] or ''} {m[2] or ''}{m[4] or ''}"),
    (re.compile(r" ('[tT])([iI][sS]|[wW][aA][sS])\b"), r" \1 \2"),
]
_BEFORE_SPACE = (re.compile(r"([^'])' "), r"\1 ' ")
_WORD = re.compile(rf"[^{BLANK}]+")
_SPAN = re.compile(SPAN_WITH_CLOSE)
_SILENT = pa.array(BAD_TOKENS + STOP_WORDS, pa.string())


def tokens_of_text(text: str) -> list[str]:
    """Tokens of one text by all rules in their order."""

    def apply(raw: str, rules: Iterable) -> str:
        for pattern, replacement in rules:
            raw = pattern.sub(replacement, raw)
        return raw

    if '"' in text or "'" in text:
        text = apply(text, [_OPENING, _COLON, _LAST, _SIGNS, _BEFORE_SPACE])
        text = apply(f" {text} ", [*_QUOTES, *_SPLIT_WORDS, *_LATE])
    else:
        text = apply(text, [_COLON, _LAST, _SIGNS, *_SPLIT_WORDS])
    return _WORD.findall(text)


def plain(values: pa.Array) -> list:
    """Strings of an array, None for null; far quicker than element by element."""
    return values.to_numpy(zero_copy_only=False).tolist()


def parted(texts: pa.Array) -> pa.Array:
    """Each text with white space between its tokens and none around them; empty for a null one."""
    out = texts
    for pattern, replacement in PLAIN_RULES:
        out = pc.replace_substring_regex(out, pattern, replacement)
    out = pc.fill_null(pc.ascii_trim_whitespace(out), "")
    other = pc.fill_null(pc.match_substring_regex(texts, OTHER_RULES), False)
    places = np.flatnonzero(other.to_numpy(zero_copy_only=False))
    if len(places):
        apart = strings(" ".join(tokens_of_text(t)) for t in plain(texts.take(pa.array(places))))
        out = pc.replace_with_mask(out, other, apart)
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lists of the tokens of each text and their sizes; where the size is 0 the list is one empty string."""
    out = parted(texts)
    lists = pc.ascii_split_whitespace(out)
    empty = pc.equal(out, "").to_numpy(zero_copy_only=False)
    return lists, np.where(empty, 0, np.diff(lists.offsets.to_numpy()))


def spaced(texts: pa.Array) -> pa.Array:
    """Tokens of each text with a blank between two; empty for a null one. No token holds a blank."""
    return pc.binary_join(words_of(texts)[0], " ")


def token_lists(texts: pa.Array) -> list[list[str]]:
    return [words.split(" ") if words else [] for words in plain(spaced(texts))]


def strip_tags(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, TAG, "")


def name_parts(names: Iterable[str]) -> dict[str, list[str]]:
    """Tokens of each name; a final lone period goes back to the token before it."""
    known = list(dict.fromkeys(names))
    parts = {}
    for name, own in zip(known, token_lists(pa.array(known, pa.string()))):
        if len(own) >= 2 and own[-1] == ".":
            own = [*own[:-2], own[-2] + "."]
        parts[name] = own
    return parts


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its end, in one array, and the sizes of the parts."""
    sizes = np.maximum(ends - starts, 0)
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes), sizes


def context_lists(
    words: pa.Array, first: np.ndarray, last: np.ndarray, start1: np.ndarray, end1: np.ndarray, start2: np.ndarray, end2: np.ndarray, window: int
) -> dict[str, pa.Array]:
    """The words before, between and behind two names each, of the text whose words are those from ``first`` up to ``last``."""
    cuts = {
        "bef": (np.maximum(start1 - window, first), start1),
        "bet": (end1, start2),
        "aft": (end2, np.minimum(end2 + window, last)),
    }
    out = {}
    for name, (start, end) in cuts.items():
        at, sizes = ranges(start, end)
        out[name] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), words.take(pa.array(at)))
    return out


def flat_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, the different ones, the places in these of the former, the texts that they are of, and where each text begins."""
    lists, _ = words_of(texts)
    encoded = lists.values.dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return lists.values, encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), of, offsets


class Names:
    """Different names as the places of their tokens among ``known`` ones; ``sizes`` are their numbers of tokens."""

    def __init__(self, names: pa.Array, known: pa.Array) -> None:
        parts = name_parts(plain(names))
        self.known = len(known)
        self.codes = pc.fill_null(pc.index_in(strings(w for name in parts.values() for w in name), value_set=known), -1)
        self.codes = self.codes.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.fromiter(map(len, parts.values()), np.int64, len(parts))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def found(self, words: np.ndarray, of: np.ndarray, last: np.ndarray, sent: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and name asked for, in their order, the places where it stands, ascending: (which was asked, position)."""
        asked = np.flatnonzero(self.sizes[name] > 0)
        first = self.codes[self.begins[name[asked]]]
        asked, first = asked[first >= 0], first[first >= 0]
        # Tokens that begin a name, by text and token: those of a name stand together.
        starts = np.zeros(self.known, bool)
        starts[first] = True
        at = np.flatnonzero(starts[words])
        keys = of[at] * max(self.known, 1) + words[at]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        wanted = sent[asked] * max(self.known, 1) + first
        places, n = ranges(np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right"))
        asked, position = np.repeat(asked, n), at[places]
        own = name[asked]
        good = position + self.sizes[own] <= last[sent[asked]]
        for step in range(1, int(self.sizes.max(initial=0))):
            rest = np.flatnonzero(good & (self.sizes[own] > step))
            good[rest] = words[position[rest] + step] == self.codes[self.begins[own[rest]] + step]
        return asked[good], position[good]


@dataclass
class Mentions:
    """Valid neighbours with a relational BET, a row each; places are those of the flat ``words`` of all texts."""

    sent: np.ndarray  # which of the batch's texts with spans
    one: np.ndarray  # entities
    two: np.ndarray
    words: pa.Array
    first: np.ndarray  # where the text's words begin
    last: np.ndarray
    start1: np.ndarray
    end1: np.ndarray
    start2: np.ndarray
    end2: np.ndarray
    known: pa.Array  # the different words, and the places in it of ``words``
    codes: np.ndarray

    def tagged(self, tags: list[str], states: Callable[..., np.ndarray]) -> pa.Array:
        """The words of the texts with mentions and their tags, as ``states`` has them of whole texts; other words have any tag."""
        _, one = np.unique(self.sent, return_index=True)
        found = states(plain(self.known), self.codes, self.first[one], self.last[one])
        return struct(tok=self.words, tag=strings(tags).take(pa.array(found)))

    def contexts(self, window: int, words: pa.Array | None = None) -> dict[str, pa.Array]:
        words = self.words if words is None else words
        return context_lists(words, self.first, self.last, self.start1, self.end1, self.start2, self.end2, window)


@dataclass
class Near:
    """Closed entities that near each other, a row for each ordered pair of a text."""

    sent: np.ndarray
    one: np.ndarray
    two: np.ndarray
    last1: np.ndarray  # where the entity is tagged last, of all spans
    last2: np.ndarray


class Batch:
    """The texts of a batch with two tagged spans or more: their places, and flat arrays of all their spans.

    ``sent`` is the text of a span, ``code`` its entity: the different (type, name) of the batch, whose types and names are ``types`` and
    ``names`` at ``type_of`` and ``name_of``; ``closed`` tells whether the closing tag is of that type. ``pieces`` stand before the spans.
    """

    def __init__(self, texts: pa.Array) -> None:
        every = plain(texts)
        self.size = len(every)
        places, kept, counts, cuts = [], [], [], []
        for i, text in enumerate(every):
            if text and "</" in text:
                cut = _SPAN.split(text)
                if len(cut) > 8:
                    # What follows the last entity is no piece.
                    cut.pop()
                    places.append(i)
                    kept.append(text)
                    counts.append(len(cut) >> 2)
                    cuts += cut
        self.places, self.counts = np.array(places, np.int64), np.array(counts, np.int64)
        self.texts, self.raw, self.closes = strings(kept), cuts[::4], cuts[3::4]
        types, names = strings(cuts[1::4]).dictionary_encode(), strings(cuts[2::4]).dictionary_encode()
        self.types, self.names = types.dictionary, names.dictionary
        self.closed = pc.equal(types.cast(pa.string()), strings(self.closes)).to_numpy(zero_copy_only=False).astype(bool)
        self.sent = np.repeat(np.arange(len(places)), self.counts)
        n = max(len(self.names), 1)
        entities, self.code = np.unique(types.indices.to_numpy().astype(np.int64) * n + names.indices.to_numpy(), return_inverse=True)
        self.type_of, self.name_of = entities // n, entities % n
        self._pieces: tuple[pa.Array, np.ndarray] | None = None

    def pieces(self) -> tuple[pa.Array, np.ndarray]:
        """The tokens of the pieces before the spans, as ``words_of`` has them."""
        if self._pieces is None:
            self._pieces = words_of(strings(self.raw))
        return self._pieces

    def pair_key(self, sent: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        n = max(len(self.name_of), 1)
        return (sent * n + one) * n + two

    def located(self, words: np.ndarray, of: np.ndarray, last: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entity, position, end) of the entity at each position, ascending; the longest wins, then the smaller type and name.

        ``words`` are the tokens of all texts as places in ``known``, ``of`` their texts, ``last`` where each text's end.
        """
        names = Names(self.names, known)
        spans = np.unique(self.sent * max(len(self.name_of), 1) + self.code)
        sent, entity = spans // max(len(self.name_of), 1), spans % max(len(self.name_of), 1)
        asked, position = names.found(words, of, last, sent, self.name_of[entity])
        entity, sizes = entity[asked], names.sizes
        name = self.name_of[entity]
        place = [np.empty(len(x), np.int64) for x in (self.types, self.names)]
        for own, x in zip(place, (self.types, self.names)):
            own[pc.sort_indices(x).to_numpy()] = np.arange(len(x))
        order = np.lexsort((place[1][name], place[0][self.type_of[entity]], -sizes[name], position))
        entity, position, name = entity[order], position[order], name[order]
        kept = np.append(True, position[1:] != position[:-1])[: len(position)]
        return entity[kept], position[kept], position[kept] + sizes[name[kept]]

    def mentions(self, least: int, most: int, types) -> Mentions:
        flat, known, words, of, offsets = flat_words(strip_tags(self.texts))
        entity, start, end = self.located(words, of, offsets[1:], known)
        start1, end1, start2, end2, one, two = start[:-1], end[:-1], start[1:], end[1:], entity[:-1], entity[1:]
        gap = start2 - start1
        good = (of[start1] == of[start2]) & (least <= gap) & (gap <= most) & (self.name_of[one] != self.name_of[two])
        if types is not None:
            allowed = np.array([[(x, y) in types for y in plain(self.types)] for x in plain(self.types)], bool).reshape(len(self.types), len(self.types))
            good &= allowed[self.type_of[one], self.type_of[two]]
        spoken = ~pc.is_in(known, value_set=_SILENT).to_numpy(zero_copy_only=False).astype(bool)
        before = np.append(0, np.cumsum(spoken[words]))
        good &= before[np.maximum(start2, end1)] > before[end1]
        start1, end1, start2, end2, one, two = (x[good] for x in (start1, end1, start2, end2, one, two))
        sent = of[start1]
        return Mentions(sent, one, two, flat, offsets[sent], offsets[sent + 1], start1, end1, start2, end2, known, words)

    def near(self, least: int, most: int) -> Near:
        # An entity counts as one token; positions grow by at least one per entity, so only the next ``most`` can be near.
        place = np.cumsum(self.pieces()[1]) + np.arange(len(self.sent))
        at = np.flatnonzero(self.closed)
        sent, code, place = self.sent[at], self.code[at], place[at]
        ones, twos = [], []
        for step in range(1, min(most, len(at) - 1) + 1):
            gap = place[step:] - place[:-step]
            one = np.flatnonzero((sent[step:] == sent[:-step]) & (least <= gap) & (gap <= most))
            ones.append(one)
            twos.append(one + step)
        one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        _, first = np.unique(self.pair_key(sent[one], code[one], code[two]), return_index=True)
        first.sort()
        one, two = one[first], two[first]
        keys = sent * max(len(self.name_of), 1) + code
        ends, last = np.unique(keys[::-1], return_index=True)
        last = at[len(at) - 1 - last]
        last1, last2 = (last[np.searchsorted(ends, keys[x])] for x in (one, two))
        return Near(sent[one], code[one], code[two], last1, last2)

    def phrases(self, near: Near, least: int, most: int) -> pa.Array:
        """The phrase between the last tags of each pair; none unless it has ``least`` to ``most`` tokens.

        Between neighbours stands a piece; with other spans between, the phrase is cut with their tags.
        """
        apart = near.last2 - near.last1
        lists, sizes = self.pieces()
        n = np.where(apart > 0, sizes[near.last2], 0)
        far = apart > 1
        between = []
        if far.any():
            names, types = plain(self.names), plain(self.types)

            def text(k: int) -> str:
                return f"<{types[self.type_of[self.code[k]]]}>{names[self.name_of[self.code[k]]]}</{self.closes[k]}>"

            between = [
                self.raw[i + 1] + "".join(text(k) + self.raw[k + 1] for k in range(i + 1, j))
                for i, j in zip(near.last1[far].tolist(), near.last2[far].tolist())
            ]
        own, n[far] = words_of(strings(between))
        words = pc.replace_with_mask(pc.binary_join(lists.take(pa.array(near.last2)), " "), pa.array(far), pc.binary_join(own, " "))
        return pc.if_else(pa.array((least <= n) & (n <= most)), words, pa.scalar(None, pa.string()))

    def pair_columns(self, one: np.ndarray, two: np.ndarray) -> dict[str, pa.Array]:
        every = {"_type": (self.types, self.type_of), "": (self.names, self.name_of)}
        return {f"e{i}{end}": values.take(pa.array(of[x])) for end, (values, of) in every.items() for i, x in ((1, one), (2, two))}

    def lists(self, sent: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
        """Rows as a list a text, by the texts with spans that they are of, ascending; none for the others."""
        sizes = np.zeros(self.size, np.int64)
        sizes[self.places] = np.bincount(sent, minlength=len(self.places))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), struct(**columns))


def strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(list(values), pa.string())


def struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


CONTEXTS = "bef array<string>, bet array<string>, aft array<string>"
MENTION = f"e1 string, e1_type string, e2 string, e2_type string, {CONTEXTS}, gap int"
PLACES = "start1 int, end1 int, start2 int, end2 int"


def ddl(fields: str) -> str:
    return f"array<struct<{re.sub(r'(^|, )([a-z0-9_]+) ', r'\1\2:', fields)}>>"


def mention_kernel(window: int, least: int, most: int, types, with_near: bool = False) -> Callable[[pa.Array], pa.Array]:
    allowed = None if types is None else frozenset(types)

    def run(texts: pa.Array) -> pa.Array:
        batch = Batch(texts)
        found = batch.mentions(least, most, allowed)
        pairs = batch.pair_columns(found.one, found.two)
        columns = {c: pairs[c] for c in ("e1", "e1_type", "e2", "e2_type")} | found.contexts(window)
        columns["gap"] = pa.array(found.start2 - found.start1, pa.int32())
        columns |= {c: pa.array(getattr(found, c) - found.first, pa.int32()) for c in ("start1", "end1", "start2", "end2")}
        if with_near:
            close = batch.near(least, most)
            flags = np.isin(batch.pair_key(found.sent, found.one, found.two), batch.pair_key(close.sent, close.one, close.two))
            columns["near"] = pa.array(flags, pa.bool_())
        return batch.lists(found.sent, columns)

    return run


def tagged_kernel(window: int, least: int, most: int, types, tags: list[str], states: Callable[..., np.ndarray]) -> Callable[[pa.Array], pa.Array]:
    allowed = None if types is None else frozenset(types)

    def run(texts: pa.Array) -> pa.Array:
        batch = Batch(texts)
        found = batch.mentions(least, most, allowed)
        pairs = batch.pair_columns(found.one, found.two)
        columns = {c: pairs[c] for c in ("e1", "e1_type", "e2", "e2_type")} | found.contexts(window, found.tagged(tags, states))
        columns["gap"] = pa.array(found.start2 - found.start1, pa.int32())
        return batch.lists(found.sent, columns)

    return run


def near_kernel(least: int, most: int) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        batch = Batch(texts)
        found = batch.near(least, most)
        return batch.lists(found.sent, batch.pair_columns(found.one, found.two) | {"phrase": batch.phrases(found, least, most)})

    return run


#: Contexts are texts with a blank between tokens.
EVIDENCE = "kind string, e1_type string, e2_type string, e1 string, e2 string, bef string, bet string, aft string, phrase string, n long, n_near long"
#: Rows that a task sums together, and rows of a list in which it gives them out.
SUMMED = 50_000
LISTED = 1_000


def evidence_rows(window: int, least: int, most: int, types, summed: int = SUMMED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Mentions and near pairs of batches of one column of texts, as lists of ``EVIDENCE`` whose counts are still to be summed."""
    allowed = None if types is None else frozenset(types)
    kinds = [c.split() for c in EVIDENCE.split(", ")]
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in kinds])
    keys = schema.names[:-2]

    def rows(kind: str, pairs: dict[str, pa.Array], n: int, **more: pa.Array) -> pa.Table:
        columns = {"kind": pa.repeat(kind, n), "n": pa.repeat(1, n), "n_near": pa.repeat(0, n)} | pairs | more
        return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def evidence(texts: pa.Array) -> list[pa.Table]:
        batch = Batch(texts)
        found, close = batch.mentions(least, most, allowed), batch.near(least, most)
        near = np.isin(batch.pair_key(found.sent, found.one, found.two), batch.pair_key(close.sent, close.one, close.two))
        stated = {c: pc.binary_join(own, " ") for c, own in found.contexts(window).items()}
        phrases, pairs = batch.phrases(close, least, most), batch.pair_columns(close.one, close.two)
        own = phrases.is_valid()
        with_phrase = {c: x.filter(own) for c, x in pairs.items()}
        return [
            rows("mention", batch.pair_columns(found.one, found.two), len(near), **stated, n_near=pa.array(near)),
            rows("hit", pairs, len(phrases), phrase=pa.repeat("", len(phrases))),
            rows("hit", with_phrase, len(phrases) - phrases.null_count, phrase=phrases.drop_null()),
        ]

    def sums(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("n_near", "sum")])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(schema.names)

    def given(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = {f.name: c.chunk(0) if c.num_chunks else pa.array([], f.type) for f, c in zip(schema, table.columns)}
        ends = np.append(np.arange(0, table.num_rows, LISTED), table.num_rows)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct(**columns))], ["x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for one in batches:
            held += evidence(one.column(0))
            if sum(t.num_rows for t in held) >= summed:
                held = [sums(held)]
                # What does not shrink much by summing is given out, the rest waits for more.
                if 2 * held[0].num_rows >= summed:
                    yield given(held[0])
                    held = []
        if held:
            yield given(sums(held))

    return run


def known_pair_kernel(window: int, least: int, most: int, forward_only: bool) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    def run(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        flat, known, words, of, offsets = flat_words(strip_tags(texts))
        # No name stands in place of a null one; the empty name has no tokens.
        encoded = pc.fill_null(pa.concat_arrays([firsts.cast(pa.string()), seconds.cast(pa.string())]), "").dictionary_encode()
        names, name = Names(encoded.dictionary, known), encoded.indices.to_numpy().astype(np.int64)
        rows = np.arange(len(texts))
        name1, name2 = name[: len(texts)], name[len(texts) :]
        (sent, start1), (sent2, start2) = (names.found(words, of, offsets[1:], rows, x) for x in (name1, name2))
        # Places ascend through all texts, so the second names within the distance of a first one stand together.
        low = np.maximum(start1 + (least if forward_only else -most), offsets[sent])
        high = np.minimum(start1 + most + 1, offsets[sent + 1])
        at, n = ranges(np.searchsorted(start2, low), np.searchsorted(start2, high))
        sent, start1, start2 = np.repeat(sent, n), np.repeat(start1, n), start2[at]
        good = np.abs(start2 - start1) >= least
        sent, start1, start2 = sent[good], start1[good], start2[good]
        places = (start1, start1 + names.sizes[name1[sent]], start2, start2 + names.sizes[name2[sent]])
        columns = {"e1": firsts.take(pa.array(sent)), "e2": seconds.take(pa.array(sent))}
        columns |= context_lists(flat, offsets[sent], offsets[sent + 1], *places, window)
        columns["gap"] = pa.array(start2 - start1, pa.int32())
        counts = np.bincount(sent, minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), struct(**columns))

    return run


def mentions_column(text: Column, window: int, least: int, most: int, types, with_near: bool = False) -> Column:
    kind = ddl(f"{MENTION}, {PLACES}" + (", near boolean" if with_near else ""))
    return F.arrow_udf(mention_kernel(window, least, most, types, with_near), kind)(text)


def tagged_column(text: Column, window: int, least: int, most: int, types, tags: list[str], states: Callable[..., np.ndarray]) -> Column:
    """Mentions whose contexts are (tok, tag), tags being those of whole texts."""
    kind = ddl(MENTION).replace("array<string>", "array<struct<tok:string,tag:string>>")
    return F.arrow_udf(tagged_kernel(window, least, most, types, tags, states), kind)(text)


def near_column(text: Column, least: int, most: int) -> Column:
    return F.arrow_udf(near_kernel(least, most), ddl("e1_type string, e2_type string, e1 string, e2 string, phrase string"))(text)


def known_pair_column(text: Column, e1: Column, e2: Column, window: int, least: int, most: int, forward_only: bool) -> Column:
    kernel = known_pair_kernel(window, least, most, forward_only)
    return F.arrow_udf(kernel, ddl(f"e1 string, e2 string, {CONTEXTS}, gap int"))(text, e1, e2)
