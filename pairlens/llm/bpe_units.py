"""Cutting texts where a byte-level BPE can't join tokens, and remembering what was encoded between the cuts.

The pre-tokenizer puts a single space before a word with that word, and what stands before such a space never depends on what
follows it. So a text may be cut before every space that no white space (and no end) follows, the units be encoded by
themselves, and their ids be joined. White space of any kind after a space keeps both in one unit.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

_GLUED = re.compile(r" (?=\s|\Z)")


def units(text: str) -> list[str]:
    """Units of a text in order, but for the first without the space they begin with; joined by spaces they give the text."""
    found = text.split(" ")
    if _GLUED.search(text):
        whole = found[:1]
        for unit in found[1:]:
            if unit and not unit[0].isspace():
                whole.append(unit)
            else:
                whole[-1] += " " + unit
        return whole
    return found


class Remembered:
    """Ids of texts as little-endian 32-bit bytes; ``encode`` is asked once for every unit that isn't remembered.

    What is remembered is bounded in units and in their length, whatever the texts hold.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 600_000, longest: int = 64) -> None:
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        split = [units(t) for t in texts]
        known = self.known
        firsts = list(dict.fromkeys(own[0] for own in split))
        missing = [u for u in set(chain.from_iterable(own[1:] for own in split)) if u not in known]
        made = self.encode(firsts + [" " + u for u in missing])
        first = dict(zip(firsts, made, strict=False))
        fresh = dict(zip(missing, made[len(firsts) :], strict=True))
        known.update(fresh)
        out = [b"".join([first[own[0]], *map(known.__getitem__, own[1:])]) for own in split]
        for unit in fresh:
            if len(unit) > self.longest:
                del known[unit]
        return out
