"""Session settings the jobs are written for."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Hot keys: joins split the oversized side at run time, also when that costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Signatures are a few hundred integers per row, so keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Whole texts have any length: by rows alone, one batch can hold all texts of a task, in the JVM and in Python at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def build_session(app: str = "pairlens", master: str | None = None, **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, app: str = "pairlens-local", **overrides: str) -> SparkSession:
    """One-machine session for tests and benchmarks."""
    cores = cores or os.cpu_count() or 4
    defaults = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Small files are read by all cores where they have several row groups; a row group is never split.
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    defaults.update(overrides)
    return build_session(app, f"local[{cores}]", **defaults)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Python gets texts in batches of bounded size, also in a session that ``build_session`` has not made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local master may fall back to a temporary folder; executors elsewhere could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pairlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    It cuts the lineage, survives the loss of executors, and gives Spark measured sizes and column
    pruning for what follows.
    """
    path = f"{shared_folder(frame.sparkSession)}/pairlens/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all cores: few small rows with much work each would else be joined into a task or two by their size."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
