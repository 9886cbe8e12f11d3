"""Sparse voxel grids: density, camera coverage, confidence and what follows from it.

A grid is a row (ox, oy, oz, nx, ny, nz) besides the cell size.  Only cells that hold something are rows; empty cells
enter percentages through the grid's shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.functions.geometry import cell, provenance
from roomweave.operators.frames import numbered
from roomweave.storage import set_checkpoint_dir

IJK = ["i", "j", "k"]
BLOCK = 16  # cells a side, where boxes meet cells
FARTHEST = 500_000  # cells from the origin, so that three places make one number


def grid(points: DataFrame, size: float, padding: float = 0.1) -> DataFrame:
    """One row: the origin (least coordinates less the padding) and the shape."""
    ends = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    extent = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"}
    return ends.select(*((F.col(f"lo_{c}") - extent[c] * padding).alias(f"o{c}") for c in "xyz"),
                       *(F.greatest(F.lit(1), F.ceil(extent[c] * (1 + 2 * padding) / size)).cast("int").alias(f"n{c}") for c in "xyz"))


def to_cells(points: DataFrame, shape: DataFrame, size: float) -> DataFrame:
    """points with their cell (i, j, k); those outside the grid are left out."""
    placed = points.crossJoin(F.broadcast(shape)).withColumns({n: cell(F.col(c), F.col(f"o{c}"), size) for n, c in zip(IJK, "xyz")})
    inside = [(F.col(n) >= 0) & (F.col(n) < F.col(f"n{c}")) for n, c in zip(IJK, "xyz")]
    return placed.where(inside[0] & inside[1] & inside[2]).drop("ox", "oy", "oz", "nx", "ny", "nz")


def density(points: DataFrame, shape: DataFrame, size: float) -> DataFrame:
    """(i, j, k, n, density): points in each cell, over the 95th percentile of filled cells, at most 1."""
    return relative(to_cells(points, shape, size).groupBy(*IJK).agg(F.count("*").alias("n")))


def relative(counts: DataFrame) -> DataFrame:
    """Counts (i, j, k, n) with density: over the 95th percentile, at most 1. Spark's percentile holds each count once with
    its number of cells, and n points make no more than the root of 2 n different counts."""
    top = counts.agg(F.greatest(F.percentile("n", F.lit(0.95)), F.lit(1e-6)).alias("top"))
    return counts.crossJoin(F.broadcast(top)).withColumn("density", F.least(F.lit(1.0), F.col("n") / F.col("top"))).drop("top")


def coverage(cameras: DataFrame, shape: DataFrame, size: float, reach: float) -> DataFrame:
    """(i, j, k, cameras, coverage): cameras (x, y, z, fx, fy, fz) that have a cell's centre before them and in reach.

    Each camera lists the cells of its own box, so the work is cameras times box, not cameras times grid.
    """
    steps = int(reach / size) + 2
    near = cameras.crossJoin(F.broadcast(shape))
    for n, c in zip(IJK, "xyz"):
        at = F.floor((F.col(c) - F.col(f"o{c}")) / size).cast("int")
        near = near.withColumn(n, F.explode(F.sequence(F.greatest(F.lit(0), at - steps), F.least(F.col(f"n{c}") - 1, at + steps))))
    for n, c in zip(IJK, "xyz"):
        near = near.withColumn(f"d{c}", F.col(f"o{c}") + (F.col(n) + 0.5) * size - F.col(c))
    seen = near.where("dx * dx + dy * dy + dz * dz < {0} * {0} AND dx * fx + dy * fy + dz * fz > 0".format(float(reach)))
    counts = seen.groupBy(*IJK).agg(F.count("*").alias("cameras"))
    most = counts.agg(F.max("cameras").alias("most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("coverage", F.col("cameras") / F.col("most")).drop("most")


def confidence(dense: DataFrame, covered: DataFrame, w_density: float = 0.6, w_coverage: float = 0.4) -> DataFrame:
    both = dense.join(covered, IJK, "full")
    part = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("density", "coverage")]
    return both.select(*IJK, (w_density * part[0] + w_coverage * part[1]).alias("confidence"))


def bands(conf: DataFrame, shape: DataFrame) -> DataFrame:
    """Per cent of all cells above 0.7, from 0.3 and below; cells without a row are 0."""
    found = conf.agg(F.count_if(F.col("confidence") > 0.7).alias("high"), F.count_if((F.col("confidence") >= 0.3) & (F.col("confidence") <= 0.7)).alias("medium"))
    cells = F.col("nx").cast("long") * F.col("ny") * F.col("nz")
    pct = lambda n: F.round(100.0 * n / cells, 2)
    return found.crossJoin(shape).select(pct(F.col("high")).alias("pct_high"), pct(F.col("medium")).alias("pct_medium"), pct(cells - F.col("high") - F.col("medium")).alias("pct_low"))


def tag_points(points: DataFrame, conf: DataFrame, shape: DataFrame, size: float) -> DataFrame:
    """(pid, confidence, provenance) of points; of those outside the grid: 0, inferred."""
    tagged = to_cells(points, shape, size).select("pid", *IJK).join(conf, IJK, "left").select("pid", "confidence")
    return points.select("pid").join(tagged, "pid", "left").select("pid", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), provenance(F.coalesce("confidence", F.lit(0.0))).alias("provenance"))


def box_confidence(boxes: DataFrame, conf: DataFrame, shape: DataFrame, size: float) -> DataFrame:
    """(label, confidence, provenance): the mean over all cells of each object's box, rounded to four places; bands are of
    the mean before. A box (label, lo_x .. hi_z) reaches from the cell of its lower end to the one after its upper end's;
    one outside the grid has 0. Boxes list blocks of BLOCK cells a side, in which they meet the cells.
    """
    placed = boxes.crossJoin(F.broadcast(shape))
    for c in "xyz":
        ends = {f"a{c}": F.floor((F.col(f"lo_{c}") - F.col(f"o{c}")) / size), f"b{c}": F.ceil((F.col(f"hi_{c}") - F.col(f"o{c}")) / size) + 1}
        placed = placed.withColumns({n: F.least(F.col(f"n{c}"), F.greatest(F.lit(0), e)).cast("int") for n, e in ends.items()})
    held = placed.where("ax < bx AND ay < by AND az < bz")
    total = held.select("label", ((F.col("bx") - F.col("ax")).cast("long") * (F.col("by") - F.col("ay")) * (F.col("bz") - F.col("az"))).alias("cells"))
    blocks, cells = held, conf.withColumns({f"b_{n}": F.floor(F.col(n) / BLOCK) for n in IJK})
    for n, c in zip(IJK, "xyz"):
        blocks = blocks.withColumn(f"b_{n}", F.explode(F.sequence(F.floor(F.col(f"a{c}") / BLOCK), F.floor((F.col(f"b{c}") - 1) / BLOCK))))
    within = F.expr("i >= ax AND i < bx AND j >= ay AND j < by AND k >= az AND k < bz")
    sums = cells.join(blocks, [f"b_{n}" for n in IJK]).where(within).groupBy("label").agg(F.sum("confidence").alias("sum"))
    mean = F.coalesce(F.try_divide(F.coalesce("sum", F.lit(0.0)), F.col("cells")), F.lit(0.0))
    return boxes.select("label").join(total, "label", "left").join(sums, "label", "left").select("label", F.round(mean, 4).alias("confidence"), provenance(mean).alias("provenance"))


def first_in_cell(points: DataFrame, size: float) -> DataFrame:
    """The point of least pid in each cell of a grid at the origin."""
    cells = [F.floor(F.col(c) / size).cast("long").alias(n) for n, c in zip(IJK, "xyz")]
    return points.select("*", *cells).groupBy(*IJK).agg(F.min_by(F.struct("pid", "x", "y", "z"), "pid").alias("p")).select(*IJK, "p.*")


def face_components(cells: DataFrame, most_rounds: int = 500) -> DataFrame:
    """(i, j, k, zone): components of cells that share faces; zone is the least number of a cell.

    Each round takes the least label of a cell and its neighbours, and then that of the cell the label names, so
    labels jump; rounds are checkpointed. Cells lie within FARTHEST of the origin on each axis.
    """
    set_checkpoint_dir(cells.sparkSession)
    number = F.expr("(CAST(i AS BIGINT) * 1000003 + j) * 1000003 + k")
    if not cells.where(" OR ".join(f"abs({n}) >= {FARTHEST}" for n in IJK)).isEmpty():
        raise ValueError(f"cells lie {FARTHEST} or more from the origin")
    own = cells.select(*IJK).distinct().withColumn("cell", number)
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))))
    beside = own.withColumn("s", F.explode(steps)).select("cell", F.expr("(CAST(i + s.a AS BIGINT) * 1000003 + j + s.b) * 1000003 + k + s.c").alias("other"))
    edges = beside.join(own.select(F.col("cell").alias("other")), "other")
    edges = edges.unionByName(edges.select(F.col("cell").alias("other"), F.col("other").alias("cell"))).checkpoint()
    labels, changed = own.select("cell", F.col("cell").alias("zone")).checkpoint(), None
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("cell").alias("other"), "zone"), "other").groupBy("cell").agg(F.min("zone").alias("near"))
        least = labels.join(near, "cell", "left").select("cell", F.least("zone", "near").alias("zone"))
        jumped = least.join(least.select(F.col("cell").alias("zone"), F.col("zone").alias("further")), "zone").select("cell", F.col("further").alias("zone"))
        labels = jumped.checkpoint()
        now = labels.agg(F.sum(F.col("zone").cast("decimal(38,0)"))).first()[0]
        if now == changed:
            return own.join(labels, "cell").select(*IJK, "zone")
        changed = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def topdown(points: DataFrame, size: float = 0.05, most: int = 4_000_000, u: str = "x", v: str = "z") -> DataFrame:
    """(i, j, n, red, green, blue, alpha) of filled cells seen from above: the mean colour and 255 times the share of the
    fullest cell's log(1 + n), both cut off. A grid of over ``most`` cells gets larger ones."""
    ends = points.agg(*(f(c).alias(f"{n}{a}") for a, c in (("u", u), ("v", v)) for n, f in (("a", F.min), ("b", F.max))))
    sides = lambda s: [F.greatest(F.lit(1), ((F.col(f"b{a}") - F.col(f"a{a}")) / s).cast("long") + 1) for a in "uv"]
    w, h = sides(size)
    grown = F.when(w * h > most, size * F.sqrt((w * h).cast("double") / most)).otherwise(F.lit(size))
    ends = ends.withColumn("s", grown)
    w, h = sides(F.col("s"))
    ends = ends.withColumns({"w": w, "h": h})
    cell_of = lambda c, a, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, ((F.col(c) - F.col(f"a{a}")) / F.col("s")).cast("long")))
    placed = points.crossJoin(F.broadcast(ends)).withColumns({"i": cell_of(u, "u", "w"), "j": cell_of(v, "v", "h")})
    cells = placed.groupBy("i", "j").agg(F.count("*").alias("n"), *(F.avg(c).cast("int").alias(c) for c in ("red", "green", "blue")))
    return cells.crossJoin(F.broadcast(cells.agg(F.max(F.log1p("n")).alias("most")))).withColumn("alpha", (F.log1p("n") / F.col("most") * 255).cast("int")).drop("most")


def zone_report(cells: DataFrame, size: float, least: int = 200, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(zone_id, zone, size_voxels, x, y, z, volume_m3) of components of face_components with at least so many cells: the
    centre in the world, and the rank by size, of equals by zone. Zones are ranked by ranges, not in one task."""
    sizes = cells.groupBy("zone").agg(F.count("*").alias("size_voxels"), *(F.avg(n).alias(f"c{n}") for n in IJK)).where(F.col("size_voxels") >= least)
    centre = [((F.col(f"c{n}") + 0.5) * size + o).alias(c) for n, c, o in zip(IJK, "xyz", origin)]
    ranked = numbered(sizes.withColumn("_size", -F.col("size_voxels")), ["_size", "zone"], "zone_id")
    return ranked.select("zone_id", "zone", "size_voxels", *centre, (F.col("size_voxels") * size**3).alias("volume_m3"))


def centroids(shape: DataFrame, size: float) -> DataFrame:
    """(i, j, k, x, y, z): the middle of each cell of the grid; layers of cells are dealt out before they are listed."""
    layers = shape.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).repartition("i")
    cells = layers.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    return cells.select(*"ijk", *((F.col(f"o{c}") + (F.col(n) + 0.5) * size).alias(c) for n, c in zip("ijk", "xyz")))
