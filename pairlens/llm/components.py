"""Connected components of a distributed edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.session import materialise


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list (a, b); component is the smallest node reachable.

    Alternates large and small stars: every node hands its larger neighbours, then its smaller ones, to the smallest node it
    sees. The edges never grow in number and shrink to stars in about log n rounds, also on long chains. Each round is written
    to the shared folder, so a lost executor costs one round at most. Self links, repeated and reversed edges are allowed,
    rows with a null end are not edges; an empty list gives an empty result.
    """
    edges = edges.select("a", "b").filter("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    for step in range(most_rounds):
        edges = materialise(_small_star(_large_star(edges)), f"{name}-{step}")
        # The multiset of edges decides whether anything moved; two sums and a count stand for it.
        found = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
        ).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): for each node, its larger neighbours go to the smallest of itself and its neighbours."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    # A larger neighbour a of u = b; u's smallest neighbour is in ``least`` if it has a smaller one, else u itself.
    met = edges.join(least, edges["b"] == least["u"], "left")
    return met.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): for each node, its smaller neighbours and itself go to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    met = edges.join(least, edges["a"] == least["u"])
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
