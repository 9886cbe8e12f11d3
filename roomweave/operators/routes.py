"""Safest ways through the graph of objects next to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.storage import set_checkpoint_dir


def safest_forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) with a < b: links of a forest in which any two nodes are joined by a way whose least sure node is as sure as can be.

    nodes (id, conf), links (a, b).  A link is as sure as its less sure end.  In each round every component takes its surest
    link to another, and components that links join become one, so rounds grow with the logarithm of the nodes.  Equal
    links are told apart by their ends, so no ring is closed.
    """
    set_checkpoint_dir(nodes.sparkSession)
    sure = nodes.select("id", "conf")
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    open_ = ends.join(sure.withColumnsRenamed({"id": "a", "conf": "ca"}), "a").join(sure.withColumnsRenamed({"id": "b", "conf": "cb"}), "b").select("a", "b", F.least("ca", "cb").alias("w")).checkpoint()
    member, forest = nodes.select("id", F.col("id").alias("c")).checkpoint(), None
    while True:
        of = lambda end: member.withColumnsRenamed({"id": end, "c": f"c_{end}"})
        across = open_.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").checkpoint()
        if across.isEmpty():
            return forest if forest is not None else open_.select("a", "b").limit(0)
        open_ = across.select("a", "b", "w")
        either = across.select(F.explode(F.array(F.struct(F.col("c_a").alias("c"), F.col("c_b").alias("to"), "w", "a", "b"), F.struct(F.col("c_b").alias("c"), F.col("c_a").alias("to"), "w", "a", "b"))).alias("e")).select("e.*")
        best = either.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("less"), "a", "b", "to")).alias("m")).select("c", "m.a", "m.b", "m.to").checkpoint()
        taken = best.select("a", "b").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        # Each component points to the one it takes; of two that take each other the smaller is the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")).checkpoint()
        while True:
            up = up.join(up.select(F.col("c").alias("root"), F.col("root").alias("next")), "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("went")).checkpoint()
            if up.where("went").isEmpty():
                break
            up = up.drop("went")
        member = member.join(up.select("c", "root"), "c", "left").select("id", F.coalesce("root", "c").alias("c")).checkpoint()


def safest_path(nodes: DataFrame, links: DataFrame, start, goal) -> DataFrame:
    """(step, id, conf) from start to goal such that the least conf on the way, ends included, is as large as can be.

    Only ways of the forest are looked at; between two nodes it has one.  No rows if no way leads there or an end is unknown;
    one row from a node to itself.  Rounds as many as the way's steps, each a join of a frontier with the forest.
    """
    tree = safest_forest(nodes, links).checkpoint()
    step = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = nodes.where(F.col("id") == F.lit(goal)).select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("next")).checkpoint()
    edge = reached
    while not edge.isEmpty() and reached.where(F.col("id") == F.lit(start)).isEmpty():
        edge = step.join(edge.select(F.col("id").alias("a"), F.col("next").alias("before")), "a").where(~F.col("b").eqNullSafe(F.col("before"))).select(F.col("b").alias("id"), F.col("a").alias("next")).checkpoint()
        reached = reached.unionByName(edge).checkpoint()
    at, way = reached.where(F.col("id") == F.lit(start)).withColumn("step", F.lit(0)), None
    while not at.isEmpty():
        way = at if way is None else way.unionByName(at)
        at = at.select(F.col("next").alias("id"), (F.col("step") + 1).alias("step")).join(reached, "id").select("id", "next", "step").checkpoint()
    if way is None:
        return nodes.limit(0).select(F.lit(0).alias("step"), "id", "conf")
    return way.join(nodes.select("id", "conf"), "id").select("step", "id", "conf")
