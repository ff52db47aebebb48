"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm._joins import dealt_anew
from siftstone.llm._scratch import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node next to it."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return dealt_anew(near, least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    tied = dealt_anew(near, least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of ``edges`` (a, b) that aren't the smallest of their component.

    Loops and repeated edges are allowed, and an empty table gives an empty
    table.  Each round is written to the shared folder; the number of rounds
    grows with the logarithm of the longest path.
    """
    edges, last = edges.where("a <> b").select("a", "b"), None
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        if last is not None:
            discard(last)
        last = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
