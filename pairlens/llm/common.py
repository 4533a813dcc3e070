"""Helpers the operators of this subpackage share."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import materialise

#: Number of a row, where rows are told apart by more than their ids.
ROW = "__row"
#: A Python batch is cut so that its texts hold about this many characters, however long single texts are.
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, split as Spark's reader splits it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(frame: DataFrame, name: str) -> DataFrame:
    """The frame with a number for each row (``ROW``), which is the same whenever the row is read again.

    Rows read straight from files are numbered by file and place in it, so nothing is stored; all others are stored with their
    numbers first, as a plan that runs again may deal them out in another order. The list of files is the reader's own.
    """
    if frame._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return materialise(frame.withColumn(ROW, F.monotonically_increasing_id()), name)
    files = sorted(r[0] for r in frame.select("_metadata.file_path").distinct().collect())
    places = frame.sparkSession.createDataFrame(list(enumerate(files)), "__file_no long, __file string")
    found = frame.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    row = (F.shiftleft("__file_no", 36) + F.col("__at")).alias(ROW)
    return found.join(F.broadcast(places), F.col("__path") == F.col("__file")).select(*frame.columns, row)


def only_rows(rows: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """The numbered rows whose numbers ``kept`` has.

    Whole rows are held against the numbers that go, as a rule far fewer than those that stay: they are broadcast while small, and
    beyond that the rows are shuffled once.
    """
    gone = materialise(rows.select(ROW).join(kept, ROW, "left_anti"), name)
    return rows.join(gone, ROW, "left_anti")


def keeps_columns(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions from documents to the same columns: columns that begin with ``__``, as the functions' own do, get other names
    on the way, so none clashes.
    """

    @wraps(function)
    def run(documents: DataFrame, *args, **kwargs) -> DataFrame:
        own = documents.columns
        if not any(c.startswith("__") for c in own):
            return function(documents, *args, **kwargs)
        held = documents.toDF(*[f"own{i}{c}" if c.startswith("__") else c for i, c in enumerate(own)])
        return function(held, *args, **kwargs).toDF(*own)

    return run


def only(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns of a frame that has others which begin with ``__``; else the frame as it is, so that files stay recognised."""
    return frame.select(*names) if any(c.startswith("__") for c in frame.columns) else frame


def key_and_text(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key as long and the text, null text as empty: other columns never reach an operator."""
    return frame.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def in_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of Arrow batches of (key, text), cut to a bounded number of characters."""
    for batch in batches:
        keys, texts, size = [], [], 0
        column = batch.column(1)
        for i, key in enumerate(batch.column(0).to_pylist()):
            text = column[i].as_py()
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def arrow_type(ddl: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}[ddl]


def map_texts(frame: DataFrame, rows: Callable[[list, list[str]], dict[str, list]], schema: str) -> DataFrame:
    """Map bounded batches of (key, text) to columns; ``schema`` is a plain "name type, ..." list."""
    names = [field.split() for field in schema.split(",")]
    target = pa.schema([(name, arrow_type(kind)) for name, kind in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in in_batches(batches):
            made = rows(keys, texts)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return frame.mapInArrow(run, schema)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine; executors ask for it themselves."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def document_columns(frame: DataFrame, text: Column, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with a new text, and n_chars to match where there is one."""
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in like.columns else {})
    return frame.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in like.columns])
