"""Byte-level BPE by a prefix-sharing walk through the trie of distinct words.

Every beginning of a BPE encoding is the encoding of its own text, and tokens form an encoding just if each two neighbours do.
So the encoding of a prefix is known by its last token and the shorter prefix before it: along a path of the trie each byte
adds one state, the token that ends there, and words with a common prefix share its states. Sorted words are the trie in
depth-first order; the states of the path stand on a stack, so memory holds one path and no nodes.
"""
from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pairlens.llm.bpe_units import Remembered
from pairlens.llm.common import key_and_text, map_texts, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
#: How the tokenizer cuts texts into words (fixed value of byte-level BPE).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Marks that, behind letters and at the end, are a word of their own by that pattern.
MARKS = ".,;:!?\"()*#&%$-"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself where it is printable, else the next from code 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        vocabulary = {k: v for k, v in read["model"]["vocab"].items() if k not in self.special}
        self.bytes: dict[int, bytes] = {i: bytes(map(letters.__getitem__, k)) for k, i in vocabulary.items()}
        self.bytes.update({i: k.encode() for k, i in self.special.items()})
        self.ids = {bytes(map(letters.__getitem__, k)): i for k, i in vocabulary.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocabulary[left + right]
            self.merged[vocabulary[left], vocabulary[right]] = rank, whole
            made.setdefault(whole, (rank, vocabulary[left], vocabulary[right]))
        self.made = made
        self.right = {i: self._spine(i, 2) for i in self.ids.values()}
        self.left = {i: self._spine(i, 1) for i in self.ids.values()}
        self.pairs: dict[int, bool] = {}
        #: Tokens that their own bytes are encoded as; no other can end a prefix.
        self.sound = {b: i for b, i in self.ids.items() if self._sound(i)}
        self.begins = {b[:i] for b in self.sound for i in range(len(b) + 1)}
        self.tails: dict[bytes, int] = {}
        self.tail_bytes: list[bytes] = []
        self.ending: list[tuple[tuple[int, int], ...]] = []
        self.follow: dict[int, int] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank that makes it) at one edge of a token, from the single byte to the token."""
        found = []
        while token in self.made:
            found.append((token, self.made[token][0]))
            token = self.made[token][side]
        return [*reversed(found + [(token, -1)])]

    def _sound(self, token: int) -> bool:
        return token not in self.made or self.joins(self.made[token][1], self.made[token][2], self.made[token][0])

    def joins(self, one: int, two: int, until: int) -> bool:
        """Whether two tokens stay apart, side by side, until the merges of rank ``until``.

        At any rank the two symbols that touch are known from the edges of both tokens. They would merge if their pair comes
        up before either of them grows into a larger symbol; at equal rank the merge further left comes first.
        """
        right, left = self.right[one], self.left[two]
        i = j = 0
        while True:
            grows = right[i + 1][1] if i + 1 < len(right) else until
            follows = left[j + 1][1] if j + 1 < len(left) else until
            rank = self.merged.get((right[i][0], left[j][0]), (until, 0))[0]
            if rank < min(grows, until) and rank <= follows:
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            if i + 1 < len(right) and (grows <= follows or j + 1 == len(left)):
                i += 1
            else:
                j += 1

    def neighbours(self, one: int, two: int) -> bool:
        key = one << 20 | two
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.joins(one, two, len(self.merged) + 1)
        return known

    def _longest_ending(self, tail: bytes) -> int:
        """Number of the longest end of ``tail`` that begins a sound token; numbers are given as ends are met."""
        while tail not in self.begins:
            tail = tail[1:]
        number = self.tails.get(tail)
        if number is None:
            number = self.tails[tail] = len(self.tail_bytes)
            self.tail_bytes.append(tail)
            ends = (tail[i:] for i in range(len(tail)))
            self.ending.append(tuple((len(e), self.sound[e]) for e in ends if e in self.sound))
        return number

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, each state of a shared prefix computed once.

        Beside the token that ends a prefix, a state holds the longest end of it that may still grow into a token: that
        names the tokens which can end there, longest first, so none is searched for.
        """
        pairs, neighbours, follow, ending = self.pairs, self.neighbours, self.follow, self.ending
        ends: list[int] = [-1]
        widths: list[int] = [0]
        tails: list[int] = [self._longest_ending(b"")]
        before, found = b"", {}
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del ends[shared + 1 :], widths[shared + 1 :], tails[shared + 1 :]
            tail = tails[-1]
            for end in range(shared + 1, len(word) + 1):
                step = tail << 8 | word[end - 1]
                tail = follow.get(step, -1)
                if tail < 0:
                    tail = follow[step] = self._longest_ending(self.tail_bytes[step >> 8] + word[end - 1 : end])
                tails.append(tail)
                for width, token in ending[tail]:
                    if width == end:
                        break
                    last = ends[end - width]
                    known = pairs.get(last << 20 | token)
                    if known or known is None and neighbours(last, token):
                        break
                else:
                    raise ValueError(f"no token can end {word[:end]!r}")
                ends.append(token)
                widths.append(width)
            ids, at = [], len(word)
            while at:
                ids.append(ends[at])
                at -= widths[at]
            ids.reverse()
            found[word] = ids
            before = word
        return found


class TrieEncoder:
    """Encodes as the tokenizer's library does, without added special tokens; special strings in a text are tokens of their own."""

    def __init__(self, path: str) -> None:
        import regex

        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(WORDS)
        self.cuts = regex.compile("|".join(map(regex.escape, self.vocabulary.special))) if self.vocabulary.special else None
        self.remembered = Remembered(self.encode_units)

    def pieces(self, unit: str) -> list[str]:
        """Words and special strings of a unit, in order."""
        body = unit[1:]
        if body.isalpha() and unit[0] == " ":
            return [unit]
        core = body.rstrip(MARKS)
        if core.isalpha() and unit[0] == " ":
            return [unit[: len(core) + 1], body[len(core) :]]
        if self.cuts is None or not any(s in unit for s in self.vocabulary.special):
            return self.words.findall(unit)
        found, last = [], 0
        for m in self.cuts.finditer(unit):
            found += self.words.findall(unit[last : m.start()]) + [m.group()]
            last = m.end()
        return found + self.words.findall(unit[last:])

    def encode_units(self, found: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        split = [self.pieces(u) for u in found]
        distinct = {w: w.encode() for own in split for w in own if w not in special}
        known = self.vocabulary.encode_words(list(distinct.values()))
        packed = {w: struct.pack(f"<{len(known[b])}I", *known[b]) for w, b in distinct.items()}
        packed.update({s: struct.pack("<I", i) for s, i in special.items()})
        return [b"".join(map(packed.__getitem__, own)) for own in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.remembered.ids(texts)

    def decode(self, packed: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 give replacement characters."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> TrieEncoder:
    """One per Python worker."""
    return TrieEncoder(tokenizer_file(tokenizer))


def encoded(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) with the ids as little-endian unsigned 32-bit integers; null text is empty and has none."""

    def rows(keys: list, texts: list[str]) -> dict[str, list]:
        return {"doc_id": keys, "ids": encoder(tokenizer).encode(texts)}

    return map_texts(key_and_text(documents), rows, "doc_id long, ids binary")


def round_trip(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row, the decoded text being made from the ids alone."""

    def rows(keys: list, texts: list[str]) -> dict[str, list]:
        own = encoder(tokenizer)
        packed = own.encode(texts)
        return {
            "doc_id": keys,
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(own.decode(p).encode()).hexdigest() for p in packed],
        }

    return map_texts(key_and_text(documents), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
