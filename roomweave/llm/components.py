"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.llm.storage import checkpointed


def _to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Link neighbours of each node to the least node among them and itself.

    upward: consider all neighbours and move those above the node; else only neighbours below, and move the node too.
    """
    if upward:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = around.join(least, "a").where("b > a")
        return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the least node that links reach.

    Each round is a pair of joins on node ids with a minimum per node, so a node with very many links is summed on the
    map side and its join can be split.  Rounds grow with the logarithm of the longest path; each is checkpointed.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = checkpointed(edges)
    mark = None
    for _ in range(most_rounds):
        edges = checkpointed(_to_least(_to_least(edges, True), False))
        new = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
