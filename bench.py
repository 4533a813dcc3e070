"""Headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pairlens.plans import classify as cl
from pairlens.session import local_session, materialise
from pairlens.sources import training as tr
from workload import fixtures as fx
from workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "tokenize",
    "extract_mentions",
    "proximity_hits",
    "evaluation_metrics",
    "minhash_signature",
    "classify_features",
    "classify_mentions",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def dealt(sf_dir: str, parts: int) -> str:
    """The same tables in ``parts`` files each: a table given as one row group is read by one core, however many there are."""
    target = Path(tempfile.mkdtemp(prefix="bench-tables-"))
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        rows = pq.read_table(path)
        size = -(-max(rows.num_rows, 1) // parts)
        (target / path.name).mkdir()
        for i, begin in enumerate(range(0, max(rows.num_rows, 1), size)):
            pq.write_table(rows.slice(begin, size), target / path.name / f"part-{i:03}.parquet")
    return str(target)


def index_rate(spark, sf_dir: str) -> tuple[float, int]:
    """Signatures and buckets (200 signatures, 25 bands) over stored features."""
    features, _ = cl.training_features(tr.parse_training(fx.run(spark, sf_dir, fx.LABELLED_LINES)))
    stored = materialise(features, "bench-features")
    rows = stored.count()
    start = time.time()
    run(cl.build_lsh_index(stored, 200, 25).buckets)
    return time.time() - start, rows


def main() -> None:
    spark = local_session(CPUS, "pairlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = dealt(SF_DIR, 2 * CPUS)
    run(fx.sentences(spark, sf_dir).select(F.length("text")))  # start-up is not measured
    times = {}
    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    seconds, rows = index_rate(spark, sf_dir)
    times["index_features"] = round(seconds, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "index_rows": rows,
                "index_rows_per_sec": round(rows / seconds, 1),
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
