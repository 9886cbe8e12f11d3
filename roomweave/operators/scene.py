"""The scene graph: relations between objects from their centres and boxes.

Nodes: (ord, label, x, y, z, lo_x .. hi_z).  Objects of a scene are few; joins between them are bounded by node pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.functions.geometry import distance
from roomweave.storage import set_checkpoint_dir

#: Fixed values.
WALLS = ["door", "window", "wall", "shelf"]
NEXT_TO, NEAR_WALL, ABOVE_MARGIN, BETWEEN_OFF = 0.80, 0.80, 0.15, 0.30


def _as(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{p}_{c}") for c in nodes.columns))


def _dist(a: str, b: str) -> Column:
    return distance(tuple(F.col(f"{a}_{c}") for c in "xyz"), tuple(F.col(f"{b}_{c}") for c in "xyz"))


def _above(a: str, b: str) -> Column:
    side = [F.col(f"{a}_{c}").between(F.col(f"{b}_lo_{c}") - ABOVE_MARGIN, F.col(f"{b}_hi_{c}") + ABOVE_MARGIN) for c in "xz"]
    return (F.col(f"{a}_y") > F.col(f"{b}_hi_y")) & side[0] & side[1]


EDGE = ("source", "target", "target_1", "target_2", "relation", "nearest_wall_obj", "distance_m")


def _edge(rows: DataFrame, relation: str, **columns: Column | str) -> DataFrame:
    """rows as edges: columns by name, the others null."""
    columns = columns | {"relation": F.lit(relation)}
    return rows.select(*((F.col(c) if isinstance(c := columns[n], str) else c).alias(n) if n in columns else F.lit(None).cast("string").alias(n) for n in EDGE))


def edges(nodes: DataFrame) -> DataFrame:
    """The relations on_top_of, next_to, near_wall and between; columns EDGE, of which a relation fills some.

    Nodes are checkpointed, since each relation joins them. Of two nodes one can be on top; the one earlier in order is
    tried first. A wall-like node is near itself; others are near the closest wall-like one, the first of equals.
    """
    set_checkpoint_dir(nodes.sparkSession)
    nodes = nodes.checkpoint()
    a, b, c = (_as(nodes, p) for p in "abc")
    metres, wall = F.round("d", 4), lambda p: F.lower(F.col(f"{p}_label")).isin(WALLS)
    pair = a.join(b, F.col("a_ord") < F.col("b_ord")).withColumn("d", _dist("a", "b")).withColumn("up", F.when(_above("a", "b"), 1).when(_above("b", "a"), 2))
    upper, lower = (F.when(F.col("up") == 1, F.col(f"{p}_label")).otherwise(F.col(f"{q}_label")) for p, q in ("ab", "ba"))
    on = _edge(pair.where("up IS NOT NULL"), "on_top_of", source=upper, target=lower, distance_m=metres)
    beside = _edge(pair.where(F.col("up").isNull() & (F.col("d") < NEXT_TO)), "next_to", source=F.least("a_label", "b_label"), target=F.greatest("a_label", "b_label"), distance_m=metres)
    own = _edge(a.where(wall("a")), "near_wall", source="a_label", target=F.lit("wall"), nearest_wall_obj=F.lower("a_label"), distance_m=F.lit(0.0))
    close = a.where(~wall("a")).join(b.where(wall("b")), F.col("a_label") != F.col("b_label")).withColumn("d", _dist("a", "b")).where(F.col("d") <= NEAR_WALL)
    walls = close.groupBy("a_ord", "a_label").agg(F.min(F.struct("d", "b_ord", "b_label")).alias("w"))
    walls = _edge(walls, "near_wall", source="a_label", target=F.lit("wall"), nearest_wall_obj="w.b_label", distance_m=F.round("w.d", 4))
    three = b.join(c, F.col("b_ord") < F.col("c_ord")).join(a, (F.col("a_label") != F.col("b_label")) & (F.col("a_label") != F.col("c_label")))
    ux, uz, vx, vz = F.col("c_x") - F.col("b_x"), F.col("c_z") - F.col("b_z"), F.col("a_x") - F.col("b_x"), F.col("a_z") - F.col("b_z")
    length = ux * ux + uz * uz
    three = three.withColumn("t", F.when(length >= 1e-9, F.try_divide(vx * ux + vz * uz, length))).where("t BETWEEN 0 AND 1")
    off = F.sqrt((vx - F.col("t") * ux) * (vx - F.col("t") * ux) + (vz - F.col("t") * uz) * (vz - F.col("t") * uz))
    between = _edge(three.where(off <= BETWEEN_OFF), "between", source="a_label", target_1="b_label", target_2="c_label", distance_m=F.round((_dist("a", "b") + _dist("a", "c")) / 2, 4))
    return on.unionByName(beside).unionByName(own).unionByName(walls).unionByName(between)


OBJECT = ("struct<label:string,centroid_3d:array<double>,bbox_min:array<double>,bbox_max:array<double>,bbox_3d:array<double>,volume_m3:double,"
          "reconstruction_confidence:double,provenance:string,frames_seen:int>")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(ord, label, centroid_3d, ...) of a JSON document of objects: by name, or a list. A name stands in for a missing label."""
    docs = spark.read.text(path, wholetext=True).select("value")
    by_name = docs.where("value NOT RLIKE '^\\\\s*\\\\['").select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{OBJECT}>"))).alias("ord", "e"))
    listed = docs.where("value RLIKE '^\\\\s*\\\\['").select(F.posexplode(F.from_json("value", f"array<{OBJECT}>")).alias("ord", "o"))
    named = by_name.select("ord", F.col("e.value").alias("o"), F.coalesce("e.value.label", "e.key").alias("name"))
    return named.unionByName(listed.select("ord", "o", F.coalesce("o.label", F.lit("unknown")).alias("name"))).select("ord", F.col("name").alias("label"), *(f"o.{c}" for c in _fields()[1:]))


def _fields() -> list[str]:
    return [f.split(":")[0] for f in OBJECT.removeprefix("struct<").removesuffix(">").replace("array<double>", "array").split(",")]


def with_boxes(objects: DataFrame) -> DataFrame:
    """objects with box, six numbers or null, and centre, three or null: bbox_3d or, where it is missing or empty, the two
    ends; centroid_3d or, where it is missing, the middle of bbox_3d. Shorter arrays count as missing."""
    long = lambda c, n: F.when(F.size(c) >= n, F.slice(c, 1, n))
    whole, lo, hi = long("bbox_3d", 6), long("bbox_min", 3), long("bbox_max", 3)
    ends = F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lo, hi))
    box = F.when(F.coalesce(F.size("bbox_3d"), F.lit(0)) > 0, whole).otherwise(ends)
    middle = F.when(whole.isNotNull(), F.array(*((F.col("bbox_3d")[k] + F.col("bbox_3d")[k + 3]) / 2 for k in range(3))))
    return objects.withColumns({"box": box, "centre": F.coalesce(long("centroid_3d", 3), middle)})


def object_confidence(objects: DataFrame, conf: DataFrame, shape: DataFrame, size: float) -> DataFrame:
    """objects by label with reconstruction_confidence and provenance from the cells of their boxes; without a box: 0, inferred."""
    from roomweave.operators.voxels import box_confidence

    boxes = with_boxes(objects).where("box IS NOT NULL").select("label", *(F.col("box")[k].alias(f"{p}{c}") for p, a in (("lo_", 0), ("hi_", 3)) for k, c in enumerate("xyz", a)))
    found = box_confidence(boxes, conf, shape, size).withColumnsRenamed({"confidence": "reconstruction_confidence"})
    return objects.drop("reconstruction_confidence", "provenance").join(found, "label", "left").withColumns({"reconstruction_confidence": F.coalesce("reconstruction_confidence", F.lit(0.0)), "provenance": F.coalesce("provenance", F.lit("inferred"))})


def read_document(spark: SparkSession, path: str, build) -> DataFrame:
    """One row with the JSON document at the path, in one line; where there is no such file, build() gives the row and its document is written there first."""
    from roomweave.sinks.documents import write_document
    from roomweave.sources.ranges import reachable

    if not reachable(path):
        write_document(build(), path)
    return spark.read.text(path, wholetext=True).select(F.to_json(F.parse_json("value")).alias("document"))


def read_share(spark: SparkSession, path: str, field: str = "pct_medium") -> float:
    """A number of a document of measures; 0 where the file or the number is missing."""
    from roomweave.sources.ranges import reachable

    if not reachable(path):
        return 0.0
    return spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", f"$.{field}").try_cast("double"), F.lit(0.0))).first()[0]


PROMPT = ("You answer questions about a room for a robot that plans its way.\nThe room as objects and their relations: {}\n"
          "Give places as (X.Xm, Y.Ym, Z.Zm). With each object give its confidence: above 0.7 it was seen well, from 0.3 in part, below that it is a guess. "
          "For a way, list its stops with their confidence and name those below 0.3.")


def prompts(document: DataFrame, questions: list[str]) -> DataFrame:
    """(question, prompt, message) for an answerer: the prompt holds the compact document, the message is the question."""
    spark = document.sparkSession
    before, behind = PROMPT.split("{}")
    return spark.createDataFrame([(q,) for q in questions], "question string").crossJoin(F.broadcast(document)).select("question", F.concat(F.lit(before), "document", F.lit(behind)).alias("prompt"), F.col("question").alias("message"))


def make_nodes(objects: DataFrame) -> DataFrame:
    """Nodes as a document holds them: places rounded to 4, volumes to 6 and confidences to 4 places, defaults for what is missing."""
    zero = F.array(*(F.lit(0.0),) * 3)
    rounded = lambda c: F.transform(F.coalesce(c, zero), lambda v: F.bround(v, 4))
    number = lambda c, places: F.bround(F.coalesce(c, F.lit(0.0)), places).alias(c)
    return objects.select("ord", F.col("label").alias("id"), "label", rounded("centroid_3d").alias("position_3d"), rounded("bbox_min").alias("bbox_min"), rounded("bbox_max").alias("bbox_max"), number("volume_m3", 6),
                          number("reconstruction_confidence", 4), F.coalesce("provenance", F.lit("inferred")).alias("provenance"), F.coalesce("frames_seen", F.lit(0)).alias("frames_seen"))


def flat(nodes: DataFrame) -> DataFrame:
    """Nodes of make_nodes as edges() takes them."""
    axes = [F.col(f"{array}")[k].alias(f"{prefix}{c}") for array, prefix in (("position_3d", ""), ("bbox_min", "lo_"), ("bbox_max", "hi_")) for k, c in enumerate("xyz")]
    return nodes.select("ord", "label", *axes)


def summary(nodes: DataFrame, pct_medium: float = 0.0) -> DataFrame:
    """One row: the room's sides, numbers of objects by provenance, and the share of cells seen in part (navigable)."""
    side = lambda k: F.round(F.max(F.col("bbox_max")[k]) - F.min(F.col("bbox_min")[k]), 3)
    count = lambda p: F.count_if(F.col("provenance") == p)
    return nodes.agg(F.array(*map(side, range(3))).alias("room_dimensions_m"), F.count("*").alias("num_objects"), count("sparse").alias("num_sparse_objects"), count("inferred").alias("num_inferred_objects"),
                     F.round(F.lit(float(pct_medium)), 1).alias("navigability_coverage_pct"))


def document(nodes: DataFrame, links: DataFrame, room: DataFrame) -> DataFrame:
    """One row with the scene graph as compact JSON: nodes in order, edges without their null fields, and the summary.

    A scene's objects are a document; many scenes are many documents, each from its own nodes.
    """
    held = nodes.agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*(c for c in nodes.columns if c != "ord")).alias("n")))).alias("v")).select(F.transform("v", lambda x: x.n).alias("nodes"))
    joined = links.agg(F.array_sort(F.collect_list(F.struct(*EDGE))).alias("edges"))
    return held.crossJoin(joined).crossJoin(room.select(F.struct("*").alias("room_summary"))).select(F.to_json(F.struct("nodes", "edges", "room_summary")).alias("document"))


def where_is(nodes: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The place, confidence, provenance and frames of an object, and its relations as text."""
    other = F.coalesce("nearest_wall_obj", F.concat_ws(" and ", "target", "target_1", "target_2"))
    said = links.where(F.col("source") == label).select(F.concat_ws(" ", "relation", other).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("relations"))
    return nodes.where(F.col("label") == label).select("label", "position_3d", "reconstruction_confidence", "provenance", "frames_seen").crossJoin(F.broadcast(said))


def low_confidence(nodes: DataFrame, below: float = 0.3) -> DataFrame:
    return nodes.where(F.col("reconstruction_confidence") < below).select("ord", "label", "reconstruction_confidence", "provenance")


def room_layout(nodes: DataFrame, origin: str) -> DataFrame:
    """All other objects by their distance from one, with the direction in the floor plane in degrees."""
    start = nodes.where(F.col("label") == origin).select(F.col("position_3d").alias("o"))
    d = lambda k: F.col("position_3d")[k] - F.col("o")[k]
    return nodes.where(F.col("label") != origin).crossJoin(F.broadcast(start)).select("label", F.round(F.sqrt(d(0) * d(0) + d(1) * d(1) + d(2) * d(2)), 4).alias("distance_m"), F.round(F.degrees(F.atan2(d(2), d(0))), 2).alias("bearing"), "reconstruction_confidence", "provenance")


def by_confidence(nodes: DataFrame) -> DataFrame:
    """Nodes from the surest on, of equals in their order."""
    return nodes.orderBy(F.desc("reconstruction_confidence"), "ord")


def banner(nodes: DataFrame) -> DataFrame:
    """(label, bar, reconstruction_confidence, provenance): a bar of ten marks, cut off below the tenth; the surest objects are first when ordered by (confidence descending, ord)."""
    full = F.floor(F.col("reconstruction_confidence") * 10).cast("int")
    return nodes.select("ord", "label", F.concat(F.repeat(F.lit("\u2588"), full), F.repeat(F.lit("\u2591"), 10 - full)).alias("bar"), "reconstruction_confidence", "provenance")
