"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or smaller-or-equal) neighbours to the least of its neighbourhood.

    Only the small star removes repeated edges; the large star at most doubles them.
    """
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b") if large else out.where("a <> b").distinct()


def star_round(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b): the same components by edges that lead more directly to the least node of each."""
    return _star(_star(edges, True), False)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    ``edges`` has columns a, b. Each round is two groupings and two joins on the node; a node with very many
    neighbours is pre-aggregated for its minimum and split by the skew join. Rounds grow with the logarithm of
    the graph's size, and nothing but two numbers a round comes to the driver.
    """
    now = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        new = scratch.table(star_round(now), "star")
        scratch.drop(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
