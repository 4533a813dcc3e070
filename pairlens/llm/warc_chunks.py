"""WARC records as a table of chunks.

A record is the rows of one record_no, the number of the page's row; record_id names the page, and several records may share it
or have none. ``data`` in the order of ``chunk_no``, put together, is the record as the WARC 1.1
format has it, header, payload and the two line ends behind it. A payload is handed on a chunk at a time, with the digest of
all payload bytes up to the chunk's end, so no step ever holds a whole oversized record, and a reader that was interrupted
knows what the digest was when a chunk ended.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import ROW, numbered, only
from pairlens.session import materialise

#: Payload bytes in a chunk.
CHUNK = 1 << 16
#: Equal payloads from this size on are stored once.
SHARED = 100

SCHEMA = "record_no long, record_id string, chunk_no long, last boolean, data binary, payload_start int, payload_end long, digest string"
_ARROW = pa.schema(
    [
        ("record_no", pa.int64()),
        ("record_id", pa.string()),
        ("chunk_no", pa.int64()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("payload_start", pa.int32()),
        ("payload_end", pa.int64()),
        ("digest", pa.string()),
    ]
)
_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r$", re.M)


def record_name(number: int, space: str) -> str:
    """Name of a record, from the number of its row and the name of the archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(space), str(number))}>"


def header(name: str, page_id: int | None, url: str | None, kind: str, size: int, digest: str, refers_to: tuple[str, int] | None) -> bytes:
    """Header of a record, with the empty line behind it. A revisit has no block; the payload's size is told apart.

    ``refers_to`` is the name of the record with the payload and the id of its page.
    """
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name),
        ("X-Page-ID", str(page_id)),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Length", str(0 if kind == "revisit" else size)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", refers_to[0]),
            ("X-Refers-To-Page-ID", str(refers_to[1])),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def parse_header(data: bytes) -> dict[str, str]:
    """Fields of the header that a record's first chunk begins with."""
    return {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[: data.index(b"\r\n\r\n") + 2])}


def page_number(name: str) -> int | None:
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def chunks(payload: bytes, size: int) -> Iterator[tuple[int, bool, memoryview, int, str]]:
    """(number, last, bytes, end, digest so far) of a payload's chunks; an empty payload has one empty chunk."""
    view, digest = memoryview(payload), hashlib.sha256()
    for number, start in enumerate(range(0, max(1, len(view)), size)):
        part = view[start : start + size]
        digest.update(part)
        end = start + len(part)
        yield number, end == len(view), part, end, digest.copy().hexdigest()


def revisits(pages: DataFrame, shared: int = SHARED) -> DataFrame:
    """(row, refers_to, refers_row) of numbered pages that repeat the payload of a page with a smaller id, and that page's row.

    Pages without an id are no one's first. Rows that repeat the smallest id are all first.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(ROW, F.col("page_id").cast("long"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    sized = sized.filter(F.col("size") >= shared)
    owner = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", ROW)))
    first = sized.groupBy("digest").agg(owner.alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("digest", F.col("owner.page_id").alias("refers_to"), F.col(f"owner.{ROW}").alias("refers_row"))
    met = sized.join(first, "digest").filter("refers_to IS NOT NULL AND (page_id IS NULL OR page_id <> refers_to)")
    return met.select(ROW, "refers_to", "refers_row")


def write_records(pages: DataFrame, name: str = "warc", chunk: int = CHUNK, shared: int = SHARED) -> DataFrame:
    """Write a record per page to the shared folder and give the stored table of chunks.

    Null html is an empty payload. The list of revisits is stored first: Spark broadcasts it if its measured size allows,
    and else joins it by a shuffle.
    """
    pages = numbered(only(pages, "page_id", "url", "html"), f"{name}-rows")
    known = materialise(revisits(pages, shared), f"{name}-revisits")
    rows = pages.select(ROW, F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    rows = rows.join(known, ROW, "left").select(ROW, "page_id", "url", "html", "refers_to", "refers_row", "digest")
    space = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in _ARROW]
            held = 0
            for i in range(batch.num_rows):
                row, page, url, html, refers, refers_row, digest = (batch.column(c)[i] for c in range(7))
                row, page, url, refers, digest = row.as_py(), page.as_py(), url.as_py(), refers.as_py(), digest.as_py()
                target = None if refers is None else (record_name(refers_row.as_py(), space), refers)
                payload = html.as_buffer()
                kind = "response" if refers is None else "revisit"
                head = header(record_name(row, space), page, url, kind, payload.size, digest, target)
                parts = chunks(payload, chunk) if refers is None else [(0, True, b"", payload.size, digest)]
                for number, last, part, end, so_far in parts:
                    front = head if number == 0 else b""
                    data = front + bytes(part) + (b"\r\n\r\n" if last else b"")
                    for column, value in zip(made, (row, f"{page}", number, last, data, len(front), end, so_far), strict=True):
                        column.append(value)
                    held += len(data)
                    if held > 8 * chunk:
                        yield _batch(made)
                        made, held = [[] for _ in _ARROW], 0
            if made[0]:
                yield _batch(made)

    return materialise(rows.mapInArrow(run, SCHEMA), name)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
_OUT = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("digest_ok", pa.bool_()),
    ]
)


def read_records(stored: DataFrame) -> DataFrame:
    """What each record of a table of chunks says, its payload digested anew from the stored bytes.

    Records of one chunk, nearly all, are read where they lie. The chunks of longer ones are brought together by record and
    streamed in order with nothing held but the digest. ``digest_ok`` is whether the bytes have the digest the header tells;
    a revisit has no bytes of its own, so it is held against its stored digest. A record whose chunks do not follow each other
    from the first to the last is an error.
    """
    alone = (F.col("chunk_no") == 0) & F.col("last")
    short = stored.filter(alone).select("record_no", "chunk_no", "last", "data", "payload_start", "digest")
    long = stored.filter(~alone).select(short.columns).repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    return short.mapInArrow(_read, OUT).unionByName(long.mapInArrow(_read, OUT))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields, digest, size = {}, hashlib.sha256(), 0
    record, due = None, 0  # the record that is open, if any, and its next chunk
    for batch in batches:
        made: list[list] = [[] for _ in _OUT]
        records, numbers, lasts, fronts, ends = (batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5))
        for i in range(batch.num_rows):
            if numbers[i] != due or record not in (None, records[i]):
                raise ValueError(f"chunk {numbers[i]} of record {records[i]} does not follow chunk {due - 1} of record {record}")
            record, due = (None, 0) if lasts[i] else (records[i], due + 1)
            data = memoryview(batch.column(3)[i].as_buffer())
            if numbers[i] == 0:
                fields, digest, size = parse_header(bytes(data[: fronts[i]])), hashlib.sha256(), 0
            part = data[fronts[i] : len(data) - 4 * lasts[i]]
            digest.update(part)
            size += len(part)
            if lasts[i]:
                told, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                own = digest.hexdigest() if kind == "response" else ends[i]
                length = size if kind == "response" else int(fields["x-payload-length"])
                row = (page_number(fields["x-page-id"]), length, own, kind, page_number(fields.get("x-refers-to-page-id", "")), own == told)
                for column, value in zip(made, row, strict=True):
                    column.append(value)
        if made[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _OUT, strict=True)], schema=_OUT)
    if record is not None:
        raise ValueError(f"record {record} ends before its chunk {due}")


def intact(read: DataFrame) -> DataFrame:
    """The records, or an error if the bytes of one do not have the digest that it tells."""
    wrong = F.raise_error(F.concat(F.lit("wrong digest in a record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("None"))))
    return read.filter(F.when(F.col("digest_ok"), F.lit(True)).otherwise(wrong.cast("boolean")))
