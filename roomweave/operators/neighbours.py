"""Distance joins of points by grid buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.functions.geometry import bucket, distance
from roomweave.storage import set_checkpoint_dir

AXES = ("x", "y", "z")


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """(pid, other, dist) for all pairs at most radius apart, a point with itself included.

    Points go to cubes of the radius' size; each meets the 27 cubes around its own in an equi-join.
    """
    cubes = [bucket(F.col(c), radius).alias(f"c{c}") for c in AXES]
    held = points.select(F.col("pid").alias("other"), *(F.col(c).alias(f"o{c}") for c in AXES), *cubes)
    around = points.select("pid", *AXES, *cubes)
    for c in AXES:
        around = around.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    dist = distance(tuple(F.col(c) for c in AXES), tuple(F.col(f"o{c}") for c in AXES))
    return around.join(held, [f"c{c}" for c in AXES]).select("pid", "other", dist.alias("dist")).where(F.col("dist") <= radius)


def keep_dense(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Points with at least so many within the radius, themselves included."""
    dense = pairs_within(points, radius).groupBy("pid").agg(F.count("*").alias("neighbours")).where(F.col("neighbours") >= least)
    return points.join(dense, "pid")


def _near(asked: DataFrame, held: DataFrame, up: int, k: int, side: float) -> DataFrame:
    """The k best of held within a cell's side of each asked point, whose cells are those of its level, up levels higher."""
    used = [r["level"] + up for r in asked.select("level").distinct().collect()]  # at most LEVELS + 1
    levels = held.withColumn("at", F.explode(F.array(*map(F.lit, used)))) if used else held.withColumn("at", F.lit(0))
    levels = levels.select("other", *(f"o{c}" for c in AXES), "at", *(_up(f"h{c}", "at").alias(f"c{c}") for c in AXES))
    around = asked.withColumn("at", F.col("level") + up).withColumns({f"c{c}": _up(f"c{c}", "at") for c in AXES})
    for c in AXES:
        around = around.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    dist = distance(tuple(F.col(c) for c in AXES), tuple(F.col(f"o{c}") for c in AXES))
    found = around.join(levels, ["at", *(f"c{c}" for c in AXES)]).select("pid", "other", dist.alias("dist"), "at")
    found = found.where((F.col("pid") != F.col("other")) & (F.col("dist") <= side * (1 - MARGIN) * F.pow(F.lit(2.0), "at")))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy("dist", "other")))
    return ranked.where(F.col("rank") <= k).select("pid", "other", "dist", "rank")


def _up(cell: str, levels: str):
    return F.expr(f"shiftright({cell}, CAST({levels} AS INT))")


#: Halvings of the extent down to the finest cells, and what a radius stays below its cell's side for the rounding of cells.
LEVELS, MARGIN = 20, 1e-8


def nearest(points: DataFrame, k: int, finest: float = 0.0) -> DataFrame:
    """(pid, other, dist, rank): the k nearest others of each point; ties by pid.

    Cells follow the density: a point starts at the smallest cell of an octree (none below the side ``finest``) that holds
    enough points, and meets the 27 cells of that size around it.  Where fewer than k lie within a cell's side, cells of
    twice the side are certain to do, as the ball then covers the cell; so there are two passes, whatever the data.
    Of points at one place, only the k + 1 of smallest pid can be a neighbour, so a heap of copies costs no square.
    Points with a null coordinate take no part; where fewer than k others exist, all of them are found.
    """
    set_checkpoint_dir(points.sparkSession)
    there = " AND ".join(f"{c} IS NOT NULL" for c in AXES)
    points = points.where(there)
    first = W.partitionBy(*AXES).orderBy("pid")
    places = points.select("pid", *AXES).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    ends = points.agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    extent = max((ends[f"hi_{c}"] - ends[f"lo_{c}"] for c in AXES if ends[f"lo_{c}"] is not None), default=0.0) or 1.0
    depth = LEVELS if finest <= 0 else max(0, min(LEVELS, math.ceil(math.log2(extent / finest))))
    side = extent * (1 + 1e-6) / 2**depth
    cell = {c: F.floor((F.col(c) - F.lit(ends[f"lo_{c}"])) / side).cast("long") for c in AXES}
    held = places.select(F.col("pid").alias("other"), *(F.col(c).alias(f"o{c}") for c in AXES), *(cell[c].alias(f"h{c}") for c in AXES)).checkpoint()
    need = min(k + 1, held.count())
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    full = held.groupBy(*(f"h{c}" for c in AXES)).count().withColumn("level", levels)
    full = full.groupBy("level", *(_up(f"h{c}", "level").alias(f"u{c}") for c in AXES)).agg(F.sum("count").alias("n")).where(F.col("n") >= need).drop("n")
    asked = points.select("pid", *AXES, *(cell[c].alias(f"c{c}") for c in AXES))
    cells = asked.select(*(f"c{c}" for c in AXES)).distinct().withColumn("level", levels).withColumns({f"u{c}": _up(f"c{c}", "level") for c in AXES})
    start = cells.join(full, ["level", *(f"u{c}" for c in AXES)], "left_semi").groupBy(*(f"c{c}" for c in AXES)).agg(F.min("level").alias("level"))
    asked = asked.join(start, [f"c{c}" for c in AXES]).checkpoint()
    once = _near(asked, held, 0, k, side).checkpoint()
    enough = once.groupBy("pid").agg(F.count("*").alias("found")).where(F.col("found") >= need - 1).select("pid")
    again = asked.join(enough, "pid", "left_anti")
    return once.join(enough, "pid", "left_semi").unionByName(_near(again, held, 1, k, side))
