"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A text of ordinary size is encoded as it is. A huge one is encoded in chunks that overlap, with the offsets of the tokens. Two
chunks are spliced at a boundary that both have in their overlap and that is proven stable: the two characters beside it stand
next to each other in no piece of the vocabulary, so no merge ever crosses it and what lies left of it never depends on what
lies right. If the overlap has no such boundary it is widened, in the end to the whole text, so the result is that of one call.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pairlens.llm.common import key_and_text, map_texts, tokenizer_file

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a text that is encoded at once, and of a chunk's overlap with the next.
HUGE = 50_000
OVERLAP = 500


class Resynchroniser:
    def __init__(self, path: str, huge: int = HUGE, overlap: int = OVERLAP) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.huge, self.overlap = huge, overlap
        #: All pairs of neighbouring characters in pieces; white space is the model's own mark for it.
        self.joined = {
            piece[i : i + 2]
            for piece in map(self.model.id_to_piece, range(self.model.get_piece_size()))
            for i in range(len(piece) - 1)
        }

    def stable(self, text: str, at: int) -> bool:
        """Whether no token can hold both characters beside ``at``."""
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.joined

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and begins in the text, in characters, of a chunk's tokens; the library gives them in bytes."""
        made = self.model.encode(text[start:end], return_type="proto").pieces
        ids = np.fromiter((p.id for p in made), np.int64, len(made))
        begins = np.fromiter((p.begin for p in made), np.int64, len(made))
        octets = np.frombuffer(text[start:end].encode(), np.uint8)
        characters = np.append(0, np.cumsum(octets & 0xC0 != 0x80))
        return ids, characters[begins] + start

    def encode_huge(self, text: str) -> np.ndarray:
        """Ids of a text of any length, chunk by chunk."""
        done: list[np.ndarray] = []
        begin, end = 0, min(len(text), self.huge)
        ids, offsets = self._chunk(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                found = self._splice(text, ids, offsets, begin, end, overlap)
                if found is not None or overlap >= end - begin:
                    break
                overlap *= 2
            if found is None:
                # No stable place in the whole chunk: it grows, and is encoded anew.
                end = min(len(text), end + (end - begin))
                ids, offsets = self._chunk(text, begin, end)
                continue
            cut, left, ids, offsets, end = found
            done.append(left)
            begin = cut
        return np.concatenate([*done, ids])

    def _splice(self, text, ids, offsets, begin, end, overlap):
        """(cut, ids left of it, ids and offsets right of it, end of the next chunk), or None without a stable boundary.

        The next chunk begins at the overlap. The cut has to be a token's begin in both, before it a character that is in
        both, and stable; behind the cut the first token of the next chunk must not be its added white space.
        """
        start = max(begin, end - overlap)
        if start <= begin:
            return None
        common = [at for at in np.unique(offsets[offsets > start]).tolist() if self.stable(text, at)]
        if not common:
            return None
        until = min(len(text), max(start + self.huge, end + self.huge // 2 + 1))
        next_ids, next_offsets = self._chunk(text, start, until)
        have = set(next_offsets.tolist())
        cut = next((at for at in reversed(common) if at in have), None)
        if cut is None:
            return None
        first = int(np.searchsorted(next_offsets, cut))
        left = ids[: int(np.searchsorted(offsets, cut))]
        return cut, left, next_ids[first:], next_offsets[first:], until

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.huge]
        made = iter(self.model.encode(short, num_threads=1))
        return [len(next(made)) if len(t) <= self.huge else len(self.encode_huge(t)) for t in texts]


@lru_cache(maxsize=2)
def resynchroniser(model: str) -> Resynchroniser:
    """One per Python worker."""
    return Resynchroniser(tokenizer_file(model))


def count_tokens(documents: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per row; null text is empty: no bytes and no tokens."""

    def rows(keys: list, texts: list[str]) -> dict[str, list]:
        counts = resynchroniser(model).counts(texts)
        return {"doc_id": keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_texts(key_and_text(documents), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
