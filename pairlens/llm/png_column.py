"""Texts as PNG images in a binary column, read back and hashed by their low frequencies.

A payload becomes an image of 8-bit grey samples, 64 to a row. The reader takes the file apart chunk by chunk, tests every
checksum, inflates the image data and undoes the row filters with numpy; the feature is a perceptual hash, the signs of the
lowest cosine-transform coefficients of a small average image against their median.
"""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairlens.llm.common import key_and_text, map_texts
from pairlens.session import materialise

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the averaged image, and of the block of low frequencies that is kept.
SMALL, LOW = 32, 8
#: Bytes of image data that one IDAT chunk holds at most.
IDAT = 1 << 16
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Filtered rows with their filter's number before them.

    Of no filter, left and upper difference, the whole image takes the one with the smallest sum of signed magnitudes.
    """
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    best = min(((int(np.abs(x.view(np.int8).astype(np.int16)).sum()), kind, x) for kind, x in ((NONE, rows), (SUB, left), (UP, up))), key=lambda x: x[:2])
    return np.concatenate([np.full((len(rows), 1), best[1], np.uint8), best[2]], axis=1)


def encode(payload: bytes, level: int = 4) -> bytes:
    """PNG of a payload whose length is a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(filtered(rows).tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def parse(file: bytes) -> tuple[int, int, bytes]:
    """(width, height, inflated data); raises ValueError on a wrong signature, checksum, kind of image or length."""
    if not file.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    view, at, head, inflate, data = memoryview(file), len(SIGNATURE), None, zlib.decompressobj(), []
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError("a chunk is cut off")
        size = int.from_bytes(view[at : at + 4], "big")
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        if len(view) < at + 12 + size or zlib.crc32(view[at + 4 : at + 8 + size]) != int.from_bytes(view[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(inflate.decompress(body))
        elif kind == b"IEND":
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not inflate.eof:
        raise ValueError("not a whole image of 8-bit grey samples")
    return head[0], head[1], b"".join(data)


def unfiltered(data: bytes, width: int, height: int) -> np.ndarray:
    """Samples of filtered rows; runs of rows with one filter are undone together where the filter allows it."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    kinds, out = rows[:, 0], np.empty((height, width), np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    above = np.zeros(width, np.uint8)
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), height], strict=True):
        kind, part = kinds[start], rows[start:end, 1:]
        if kind == NONE:
            out[start:end] = part
        elif kind == SUB:
            out[start:end] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == UP:
            out[start:end] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (AVERAGE, PAETH):
            for r in range(start, end):
                out[r] = _by_sample(kind, rows[r, 1:], out[r - 1] if r else above)
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[end - 1]
    return out


def _by_sample(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth need each sample's left neighbour first."""
    made, left, corner = [], 0, 0
    for x, up in zip(row.tolist(), above.tolist(), strict=True):
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (x + guess) & 255, up
        made.append(left)
    return np.array(made, np.uint8)


def decode(file: bytes) -> bytes:
    """The payload of an image written by ``encode``, or of any PNG of 8-bit grey samples."""
    width, height, data = parse(file)
    if len(data) != height * (width + 1):
        raise ValueError("the image data has the wrong length")
    return unfiltered(data, width, height).tobytes()


def cosine_rows(n: int, k: int) -> np.ndarray:
    """The k lowest vectors of the cosine transform over n samples."""
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


_COSINES = cosine_rows(SMALL, LOW)


def low_frequency_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest coefficients of the image, averaged to 32 x 32, lie above their median.

    Images of fewer than 32 rows repeat rows. The constant coefficient says nothing of the structure and is left out of the median.
    """
    height, width = samples.shape
    if height < SMALL:
        samples = samples[np.arange(SMALL) * height // SMALL]
        height = SMALL
    rows = np.add.reduceat(samples, np.arange(SMALL) * height // SMALL, axis=0, dtype=np.int64)
    sums = rows.reshape(SMALL, SMALL, width // SMALL).sum(2)
    counts = np.diff(np.append(np.arange(SMALL) * height // SMALL, height))
    small = sums / counts[:, None] / (width // SMALL)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(documents: DataFrame, name: str = "png") -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder: each text as a PNG in a binary column; null text is empty."""

    def rows(keys: list, texts: list[str]) -> dict[str, list]:
        data = [t.encode() for t in texts]
        return {"doc_id": keys, "n_bytes": list(map(len, data)), "media": [encode(padded(d)) for d in data]}

    return materialise(map_texts(key_and_text(documents), rows, "doc_id long, n_bytes long, media binary"), name)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def features(stored: DataFrame) -> DataFrame:
    """What the stored images hold, all of it from the bytes read back. An image that fails a test raises."""

    def run(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                media = batch.column(2)[i].as_py()
                payload = decode(media)
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                made.append(
                    (
                        batch.column(0)[i].as_py(),
                        batch.column(1)[i].as_py(),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-WIDTH:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        low_frequency_hash(samples),
                    )
                )
            if made:
                names = [f.split()[0] for f in FEATURES.split(", ")]
                kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
