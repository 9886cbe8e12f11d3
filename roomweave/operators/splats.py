"""Splats as surfaces: large ones become grids of points, and what lies far outside goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.functions.geometry import quaternion_matrix, sigmoid

PIECE = 4096  # points of a grid that a row lists
MOST = 200  # points a side of a grid


def opaque(splats: DataFrame, least: float, strict: bool = False, column: str = "opacity") -> DataFrame:
    """Splats whose opacity, a logit, is at least so much, or strictly more."""
    x = sigmoid(F.col(column).cast("double"))
    return splats.where(x > least if strict else x >= least)


def inflate(splats: DataFrame, key: str, spacing: float = 0.007, large: float = 0.02, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """(key, sample, x, y, z, kept columns): a splat with a radius of at least ``large`` as a grid, any other as its centre.

    splats: key, x, y, z, scale (logs of three radii), rot (w, x, y, z).  The grid spans the two largest radii along the
    first two axes of the rotation, whichever radii are the largest, with 1 to ``most`` points a side about ``spacing``
    apart; one point alone lies at the lower end.  A grid of one point, and a splat of zero rotation, is its centre.

    Grids are cut into pieces of PIECE points, which are dealt anew before they are listed, so that a few large splats are
    not the work of one task.
    """
    held = [key, "x", "y", "z", *(keep or [])]
    radii = F.sort_array(F.transform("scale", lambda s: F.exp(s.cast("double"))), asc=False)
    r = quaternion_matrix(*(F.get("rot", F.lit(k)).cast("double") for k in range(4)))
    sized = splats.select(*held, radii.alias("_s"), F.array(*(r[k] for k in (0, 3, 6))).alias("_u"), F.array(*(r[k] for k in (1, 4, 7))).alias("_v"))
    side = lambda k: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(2 * F.col("_s")[k] / spacing))).cast("long")
    sized = sized.withColumns({"_n0": side(0), "_n1": side(1)})
    grid = (F.col("_s")[0] >= large) & (F.col("_n0") * F.col("_n1") > 1) & F.col("_u")[0].isNotNull()
    small = sized.where(~F.coalesce(grid, F.lit(False))).select(key, F.lit(0).cast("long").alias("sample"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *(keep or []))
    pieces = sized.where(grid).withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n0") * F.col("_n1") - 1, F.lit(PIECE).cast("long")))).repartition(key, "_first")
    listed = pieces.withColumn("sample", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + PIECE, F.col("_n0") * F.col("_n1")) - 1)))

    def along(k: int, i: Column) -> Column:
        n, s = F.col(f"_n{k}"), F.col("_s")[k]
        return F.when(n == 1, -s).otherwise(F.try_divide(2 * s * i, n - 1) - s)

    a, b = along(0, F.col("sample") % F.col("_n0")), along(1, F.floor(F.col("sample") / F.col("_n0")))
    placed = [(F.col(c).cast("double") + F.col("_u")[k] * a + F.col("_v")[k] * b).alias(c) for k, c in enumerate("xyz")]
    return small.unionByName(listed.select(key, "sample", *placed, *(keep or [])))


def within_bounds(points: DataFrame, of: DataFrame, more: float = 0.2) -> DataFrame:
    """Points in the box around others and a share of its sides beyond."""
    ends = of.agg(*(f(c).cast("double").alias(f"_{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))))
    inside = F.lit(True)
    for c in "xyz":
        a, b = F.col(f"_a{c}"), F.col(f"_b{c}")
        inside = inside & F.col(c).between(a - more * (b - a), b + more * (b - a))
    return points.crossJoin(F.broadcast(ends)).where(inside).select(*points.columns)  # one row
