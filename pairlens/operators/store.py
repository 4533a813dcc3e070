"""Stored intermediates that later runs read instead of reading the corpus and the knowledge base again.

A table lies in a folder named by a digest of its manifest: every parameter its content depends on, among them a
fingerprint of the input files.  The manifest is written last, so a folder without one, or with another one, is
built again; a changed corpus, window, word list or threshold never meets stale data.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def safe_name(text: str) -> str:
    """A folder name; a digest keeps values apart that differ only in replaced characters."""
    plain = "".join(c if c.isalnum() or c in ",.-" else "_" for c in text[:60])
    return f"{plain}-{hashlib.md5(text.encode()).hexdigest()[:12]}"


def fingerprint(frame: DataFrame) -> str:
    """Count, size and two hashes of names, sizes and times of the files behind ``frame``; no file is opened.

    It tells files apart, not what was made of them: a caller that derives several corpora from the same files
    gives each its ``version`` in the store.
    """
    files = sorted(unquote(f) for f in frame.inputFiles())
    if not files:
        raise ValueError("no input files: a stored intermediate needs something to tell its inputs by")
    listed = frame.sparkSession.read.format("binaryFile").load(files)
    parts = ["path", "length", "modificationTime"]
    row = listed.select(*parts).agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64(*parts)), F.bit_xor(F.xxhash64(F.lit(1), *parts))
    ).first()
    return ":".join(str(v) for v in row)


def _manifest_file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_manifest(spark: SparkSession, path: str) -> str | None:
    file, system = _manifest_file(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, text: str) -> None:
    file, system = _manifest_file(spark, path)
    stream = system.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def reuse_or_write(
    spark: SparkSession, base: str, name: str, params: dict, build: Callable[[], DataFrame], partition_by: Iterable[str]
) -> DataFrame:
    """Read the table whose manifest says ``params``, or build and store it."""
    manifest = json.dumps(params, sort_keys=True, default=str)
    path = f"{base.rstrip('/')}/{name}/{safe_name(manifest)}"
    if stored_manifest(spark, path) != manifest:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        write_manifest(spark, path, manifest)
    return spark.read.parquet(path)


def materialise_superset(spark: SparkSession, base: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Distinct mentions, or all counted evidence of a corpus, per argument types."""
    return reuse_or_write(spark, base, "superset", params, build, ["e1_type", "e2_type"])


def materialise_kb_split(spark: SparkSession, base: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What the corpus says about pairs, with ``known``: inside or outside the knowledge base."""
    rows = reuse_or_write(spark, base, "kb_split", params, build, ["rel_type", "known"])
    # A folder's name is read as text.
    return rows.withColumn("known", F.col("known").cast("boolean"))


def materialise_high_pmi(spark: SparkSession, base: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Supported mentions outside the knowledge base."""
    return reuse_or_write(spark, base, "high_pmi", params, build, ["rel_type"])


@dataclass(frozen=True)
class Store:
    """A shared folder; ``version`` names the way corpora are derived from their files."""

    base: str
    version: str = ""

    def key(self, frame: DataFrame, **params) -> dict:
        return {"files": fingerprint(frame), "version": self.version, **params}
