"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours (greater ones, or the rest) to the least of them all."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else \
        met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has an edge (a, b).

    Each round is written to the shared folder; the loop ends when a round
    changes nothing, after about log(n) rounds. An empty table gives an empty one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    before = None
    while True:
        last, edges = edges, durable(_stars(_stars(edges, True), False))
        if before is not None:
            discard(last)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
