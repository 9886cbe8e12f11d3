"""Camera frames and their annotations: projection, masks, votes, detections, trajectories, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomweave.functions.geometry import lerp, slerp
from roomweave.operators.packs import alike, finite, numbers, packed, spread
from roomweave.storage import set_checkpoint_dir


CAMERAS = 65_536  # of a pack that zones meet
ZONES = 4096  # of a pack
LEAF = 16  # cameras of a box
BRANCH = 8  # boxes of a box
TREES = 8  # packs of cameras whose boxes a task keeps
VIEWERS = 50_000  # cameras in a broadcast; four areas count as one
PART = 1024  # points of a pack
VIEWS = 256  # cameras of a pack
STRIP = 64  # cameras that meet a pack of points at a time
PAIRS = 20_000_000  # of points and cameras in a task
COARSE = 4  # blocks a side of a coarse one
_POSE = ("tx", "ty", "tz", "fx", "fy", "cx", "cy", "width", "height")


def _reached(places: np.ndarray, r: np.ndarray, pose: np.ndarray, near: float) -> np.ndarray:
    """The cameras into whose view the sphere around some places reaches."""
    low, high = places.min(0), places.max(0)
    t, (fx, fy, cx, cy, width, height) = pose[:, :3], pose[:, 3:].T
    centre = (low + high) / 2
    x, y, z = (r.reshape(-1, 3, 3) @ centre + t).T
    radius = np.sqrt(((high - low) ** 2).sum()) / 2 * (1 + 1e-9) + 1e-9 * (1 + np.abs(centre).sum() + np.abs(t).sum(1))
    held = z + radius > near
    for side, focal, middle, size in ((x, fx, cx, width), (y, fy, cy, height)):
        for sign, edge in ((1, middle + 0.5), (-1, size - 0.5 - middle)):
            held &= sign * focal * side + edge * z >= -radius * np.hypot(focal, edge)
    return np.flatnonzero(held)


def _first_area(u: np.ndarray, v: np.ndarray, first: np.ndarray, n: np.ndarray, areas: np.ndarray) -> np.ndarray:
    """For each pixel the first of its camera's areas (first, n of them) that holds it, else -1."""
    found, left, k = np.full(len(u), -1), np.flatnonzero(n > 0), 0
    while len(left):
        area = first[left] + k
        x0, x1, y0, y1 = areas[area].T
        inside = (u[left] >= x0) & (u[left] < x1) & (v[left] >= y0) & (v[left] < y1)
        found[left[inside]] = area[inside]
        k += 1
        left = left[~inside & (n[left] > k)]
    return found


def project(points: DataFrame, cameras: DataFrame, near: float = 0.05, block: float = 0.5, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(frame, pid, u, v): points before each camera and in its image; keep and carry are further columns of the points and cameras.

    Cameras (frame, r array of 9, tx, ty, tz, fx, fy, cx, cy, width, height).  Where they have ``areas``, an array of (x0, x1, y0, y1, value),
    only pixels in one of their camera's areas are left, with the ``value`` of the first that holds them.

    Points are dealt by ranges of space, which is all that is shuffled, and packed; each pack meets packs of cameras, of which
    those are left whose view the sphere around its points reaches.  Points of one place are projected once, and so are cameras of
    one pose.  Cameras are broadcast up to VIEWERS of them; beyond that, packs meet in tasks for each pair of their parts.
    """
    set_checkpoint_dir(points.sparkSession)
    held = cameras.where(F.col("r").isNotNull() & finite(*_POSE))
    lists = "areas" in cameras.columns
    of_camera = ["frame", "r", *_POSE, *carry, *(["areas"] if lists else [])]
    views = held.select(*of_camera).checkpoint()
    n_cameras, entries = views.agg(F.count("*"), F.coalesce(F.sum(F.size("areas")), F.lit(0)) if lists else F.lit(0)).first()
    weight = n_cameras + max(0, entries) // 4
    placed = points.select("pid", *"xyz", *keep).where(finite(*"xyz"))
    tasks = int(min(10_000, max(points.sparkSession.sparkContext.defaultParallelism, placed.count() * n_cameras // PAIRS)))
    at = [[F.floor(F.col(c) / size) for c in "xyz"] for size in (block * COARSE, block)]
    packs = packed(placed, [*at[0], *at[1], *map(F.col, "xyz"), F.col("pid")], tasks, PART, "p")
    viewers = packed(views, [*map(F.col, _POSE), F.col("r"), F.col("frame")], max(1, -(-weight // VIEWERS)), VIEWS, "c")
    kinds = dict(zip(("p", "c"), (placed.schema, views.schema)))
    of = [("c", "frame"), ("p", "pid"), *(("p", c) for c in keep), *(("c", c) for c in carry)]
    fields = [T.StructField(n, kinds[p][n].dataType) for p, n in of]
    fields[2:2] = [T.StructField(c, T.IntegerType()) for c in "uv"]
    if lists:
        fields.append(T.StructField("value", kinds["c"]["areas"].dataType.elementType["value"].dataType))
    names = [f.name for f in fields]

    def see(batches):
        for b in batches:
            for k in range(b.num_rows):
                places, pose = numbers(b, k, "p_x", "p_y", "p_z"), numbers(b, k, *(f"c_{c}" for c in _POSE))
                r = b.column("c_r")[k].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
                one_place, many_points = alike(places)
                one_pose, many_frames = alike(np.hstack([pose, r]))
                x, y, z = places[one_place].T
                reached = _reached(places, r[one_pose], pose[one_pose], near)
                if lists:
                    listed = b.column("c_areas")[k].values
                    n_areas = np.nan_to_num(pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(float)).astype(int)
                    first_area = np.cumsum(n_areas) - n_areas
                    listed = listed.flatten()
                    areas = np.stack([listed.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "x1", "y0", "y1")], 1)
                for s in range(0, len(reached), STRIP):
                    some = reached[s : s + STRIP]
                    turn = r[one_pose[some]].T[:, :, None]
                    tx, ty, tz, fx, fy, cx, cy, width, height = pose[one_pose[some]].T[:, :, None]
                    with np.errstate(all="ignore"):
                        depth = turn[6] * x + turn[7] * y + turn[8] * z + tz
                        u = np.rint((turn[0] * x + turn[1] * y + turn[2] * z + tx) / depth * fx + cx)
                        v = np.rint((turn[3] * x + turn[4] * y + turn[5] * z + ty) / depth * fy + cy)
                        c, p = np.nonzero((depth > near) & (u >= 0) & (u < width) & (v >= 0) & (v < height))
                    u, v = u[c, p], v[c, p]
                    run, camera = spread(one_pose[some[c]], many_frames[some[c]])
                    u, v, p = u[run], v[run], p[run]
                    if lists:
                        area = _first_area(u, v, first_area[camera], n_areas[camera], areas)
                        u, v, p, camera, area = (w[area >= 0] for w in (u, v, p, camera, area))
                    run, point = spread(one_place[p], many_points[p])
                    index = {"c": pa.array(camera[run]), "p": pa.array(point)}
                    found = [b.column(f"{q}_{n}")[k].values.take(index[q]) for q, n in of]
                    found[2:2] = [pa.array(w[run].astype(np.int32)) for w in (u, v)]
                    if lists:
                        found.append(listed.field("value").take(pa.array(area[run])))
                    yield pa.record_batch(found, names=names)

    return packs.crossJoin(F.broadcast(viewers) if weight <= VIEWERS else viewers).mapInArrow(see, T.StructType(fields))


def areas(masks: DataFrame, least_conf: float, most_cover: float) -> DataFrame:
    """(frame, areas) as project takes them, of boxes (frame, label, x, y, w, h, conf, cover, ord): the smallest first, then the surest, then the last."""
    good = masks.where((F.col("conf") >= least_conf) & (F.col("cover") <= most_cover))
    box = F.struct((F.col("w") * F.col("h")).alias("size"), (-F.col("conf")).alias("conf"), (-F.col("ord")).alias("ord"), F.struct(F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1"), F.col("label").alias("value")).alias("area"))
    return good.groupBy("frame").agg(F.array_sort(F.collect_list(box)).alias("boxes")).select("frame", F.col("boxes.area").alias("areas"))


def vote(labels: DataFrame, least: int, weight: str | None = None) -> DataFrame:
    """(pid, class_idx, votes, total) of points with enough votes in all; ties go to the lower class. weight: a column of votes a row."""
    counts = labels.groupBy("pid", "class_idx").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    won = counts.groupBy("pid").agg(F.max(F.struct("n", (-F.col("class_idx")).alias("c"))).alias("best"), F.sum("n").alias("total"))
    return won.where(F.col("total") >= least).select("pid", (-F.col("best.c")).alias("class_idx"), F.col("best.n").alias("votes"), "total")


def class_stats(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_idx, n, pct) of all classes, also those without points."""
    counts = labels.groupBy("class_idx").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return classes.join(counts, "class_idx", "left").crossJoin(F.broadcast(total)).select("class_idx", n.alias("n"), F.round(F.coalesce(F.try_divide(100.0 * n, F.col("total")), F.lit(0.0)), 2).alias("pct"))


def sigma_clip(points: DataFrame, key: str, sigmas: float = 2.0) -> DataFrame:
    """Points within so many population deviations of their group's mean on every axis; groups of under 4 stay."""
    stats = points.groupBy(key).agg(F.count("*").alias("group_n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    close = F.lit(True)
    for c in "xyz":
        close = close & (F.abs(F.col(c) - F.col(f"mean_{c}")) <= sigmas * F.greatest(F.col(f"dev_{c}"), F.lit(1e-6)))
    return points.join(stats, key).where((F.col("group_n") < 4) | close).select(*points.columns)


def object_stats(points: DataFrame, key: str = "label") -> DataFrame:
    sides = F.lit(1.0)
    for c in "xyz":
        sides = sides * (F.max(c) - F.min(c))
    return points.groupBy(key).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.min(c).alias(f"lo_{c}") for c in "xyz"), *(F.max(c).alias(f"hi_{c}") for c in "xyz"),
                                   sides.alias("volume"), F.count("*").alias("points"), F.countDistinct("frame_num").alias("frames"))


def as_of(rows: DataFrame, track: str, order: str, key: Column, values: list[str], turn: list[str] = ()) -> DataFrame:
    """rows with values interpolated between the key rows before and after on their track; beyond the ends, the end's.
    turn: the four columns of a unit quaternion, interpolated along the shorter arc.

    how: exact, between, or clamped. Windows over each track; a track's rows meet in one task, as its order demands.
    """
    w = W.partitionBy(track).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    point = F.when(key, F.struct(F.col(order).alias("at"), *(F.col(v).alias(v) for v in [*values, *turn])))
    near = rows.withColumns({"_key": key, "_a": F.last(point, True).over(back), "_b": F.first(point, True).over(ahead)})
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    near = near.withColumns({"_from": a, "_to": b}).where("_from IS NOT NULL")
    t = F.coalesce(F.try_divide((F.col(order) - F.col("_from.at")).cast("double"), (F.col("_to.at") - F.col("_from.at")).cast("double")), F.lit(0.0))
    how = F.when(F.col("_key"), "exact").when(F.col("_a").isNull() | F.col("_b").isNull(), "clamped").otherwise("between")
    t = F.when(how == "clamped", 0.0).otherwise(t)
    turned = slerp([F.col(f"_from.{v}") for v in turn], [F.col(f"_to.{v}") for v in turn], t) if turn else []
    return near.select(track, order, how.alias("how"), *(lerp(F.col(f"_from.{v}"), F.col(f"_to.{v}"), t).alias(v) for v in values), *(c.alias(v) for c, v in zip(turned, turn)))


def best_detections(rows: DataFrame) -> DataFrame:
    """Per frame and label the surest detection, of equals the first."""
    return rows.groupBy("frame_num", "label").agg(F.max_by(F.struct("ord", "conf"), F.struct("conf", -F.col("ord"))).alias("b")).select("frame_num", "label", "b.ord", "b.conf")


class _Boxes:
    """Finite places, halved along their widest axis down to boxes of LEAF; up to BRANCH neighbouring boxes form one of the level above."""

    def __init__(self, places: np.ndarray):
        n, halvings = len(places), max(0, int(np.ceil(np.log2(len(places) / LEAF))))
        order = np.minimum(np.arange(LEAF << halvings), n - 1)[None]  # the last place again where some lack
        for _ in range(halvings):
            p = places[order]
            widest = (p.max(1) - p.min(1)).argmax(1)
            along = np.take_along_axis(p, widest[:, None, None], 2)[:, :, 0]
            order = np.take_along_axis(order, along.argsort(1, kind="stable"), 1).reshape(2 * len(order), -1)
        self.places, self.leaf = places, order
        ends = places[order].min(1), places[order].max(1)
        self.levels = [ends]  # low and high corners, from the leaves up
        while len(ends[0]) > BRANCH:
            first = np.arange(0, len(ends[0]), BRANCH)
            ends = tuple(f.reduceat(e, first, axis=0) for f, e in zip((np.minimum, np.maximum), ends))
            self.levels.append(ends)

    def _gap(self, zone: np.ndarray, level: int, box: np.ndarray) -> np.ndarray:
        """Squares of the distances from zones to boxes beside them."""
        low, high = self.levels[level]
        gap = np.zeros(box.shape)
        for c in range(3):
            side = np.maximum(np.maximum(low[box, c] - zone[:, None, c], zone[:, None, c] - high[box, c]), 0)
            gap += side * side
        return gap

    def _away(self, zone: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        d = [zone[:, None, c] - self.places[self.leaf[leaf], c] for c in range(3)]
        return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def _below(self, level: int, box: np.ndarray) -> np.ndarray:
        """The boxes in each of some of a level, the last again where some lack."""
        return np.minimum(box[:, None] * BRANCH + np.arange(BRANCH), len(self.levels[level - 1][0]) - 1)

    def nearest(self, zones: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """For each zone the number of the nearest place, of equals the first, and its distance."""
        best, dist, top = np.empty(len(zones), int), np.empty(len(zones)), len(self.levels) - 1
        for s in range(0, len(zones), step):
            zone = zones[s : s + step]
            every = np.broadcast_to(np.arange(len(self.levels[top][0])), (len(zone), len(self.levels[top][0])))
            whole = self._gap(zone, top, every)
            box = whole.argmin(1)
            for level in range(top, 0, -1):
                inner = self._below(level, box)
                box = inner[np.arange(len(zone)), self._gap(zone, level - 1, inner).argmin(1)]
            bound = self._away(zone, box).min(1)
            # Some more than the bound, as gaps and distances are rounded: what is as near as the nearest is met.
            most = bound * bound * (1 + 1e-9) + 1e-300
            row, box = np.nonzero(whole <= most[:, None])
            for level in range(top, 0, -1):
                inner = self._below(level, box)
                held = self._gap(zone[row], level - 1, inner) <= most[row][:, None]
                held[:, 1:] &= inner[:, 1:] != inner[:, :-1]
                at, k = np.nonzero(held)
                row, box = row[at], inner[at, k]
            d = self._away(zone[row], box)
            least = d.min(1)
            number = np.where(d == least[:, None], self.leaf[box], len(self.places)).min(1)
            first = np.searchsorted(row, np.arange(len(zone)))
            dist[s : s + step] = found = np.minimum.reduceat(least, first)
            best[s : s + step] = np.minimum.reduceat(np.where(least == found[row], number, len(self.places)), first)
        return best, dist


def _nearest_odd(zone: np.ndarray, places: np.ndarray) -> tuple[int, float]:
    """The same of one zone by all distances, the infinite after the finite ones, then those that are no number."""
    with np.errstate(all="ignore"):
        d = np.sqrt(((zone - places) ** 2).sum(1))
    number = int(np.where(np.isnan(d), np.inf, d).argmin())
    if not d[number] < np.inf:
        number = int(np.argmax(d == np.inf))
    return number, float(d[number])


def nearest_camera(zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """(zone, camera, dist): the closest camera, of equals the first; zones without a place have the first camera and no distance.

    Cameras of one place count as the first of them.  Packs of zones, as they come, meet packs of up to CAMERAS, in which boxes of LEAF
    cameras rule out most for each zone.  Cameras are broadcast up to VIEWERS of them; beyond that, packs meet in tasks for each
    pair of their parts.  What is shuffled is a row a zone and pack.
    """
    set_checkpoint_dir(zones.sparkSession)
    placed = cameras.withColumn("unplaced", F.col("cx").isNull() | F.col("cy").isNull() | F.col("cz").isNull())
    first = placed.groupBy("cx", "cy", "cz", "unplaced").agg(F.min("camera").alias("camera")).checkpoint()
    n = first.count()
    kinds = dict(zones.dtypes)["zone"], dict(cameras.dtypes)["camera"]
    packs = packed(zones.select("zone", *"xyz"), [], 1, ZONES, "z")
    viewers = packed(first, [F.col("camera")], max(1, -(-n // VIEWERS)), CAMERAS, "c")

    def search(batches):
        trees = {}  # by the first camera of a pack
        for b in batches:
            for k in range(b.num_rows):
                zone, place = numbers(b, k, "z_x", "z_y", "z_z"), numbers(b, k, "c_cx", "c_cy", "c_cz")
                pack = b.column("c_camera")[k].values[0].as_py()
                missing = np.logical_or.reduce([b.column(f"z_{c}")[k].values.is_null().to_numpy(zero_copy_only=False) for c in "xyz"])
                held = np.flatnonzero(~b.column("c_unplaced")[k].values.to_numpy(zero_copy_only=False))
                # Squares of larger numbers are no longer finite.
                plain, sound = (np.flatnonzero((np.abs(p) < 1e150).all(1)) for p in (zone, place))
                best, dist = np.zeros(len(zone), int), np.full(len(zone), np.nan)
                missing |= not len(held)
                if len(sound) and len(plain):
                    if pack not in trees:
                        trees = trees if len(trees) < TREES else {}
                        trees[pack] = _Boxes(place[sound])
                    number, dist[plain] = trees[pack].nearest(zone[plain])
                    best[plain] = sound[number]
                done = np.zeros(len(zone), bool)
                done[plain] = len(sound) > 0
                for i in np.flatnonzero(~done & ~missing):
                    number, dist[i] = _nearest_odd(zone[i], place[held])
                    best[i] = held[number]
                ids = b.column("c_camera")[k].values.take(pa.array(best))
                yield pa.record_batch([b.column("z_zone")[k].values, ids, pa.array(dist, mask=missing)], names=["zone", "camera", "dist"])

    found = packs.crossJoin(F.broadcast(viewers) if n <= VIEWERS else viewers).mapInArrow(search, f"zone {kinds[0]}, camera {kinds[1]}, dist double")
    least = F.min(F.struct(F.col("dist").isNull().alias("none"), F.col("dist").alias("d"), "camera")).alias("m")
    return found.groupBy("zone").agg(least).select("zone", "m.camera", F.col("m.d").alias("dist"))


def numbered(rows: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task for all: ranges of the order are counted, then numbered.

    The ranges are checkpointed, so that they are the same where they are counted and where they are numbered.
    """
    set_checkpoint_dir(rows.sparkSession)
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    w = W.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))  # a row a partition
    return parts.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(before), "_part").withColumn(name, F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_rn", "_n", "_before")


def order_map(rows: DataFrame, names: list, order: list) -> DataFrame:
    """rows with orig_idx, their place by name, and sorted_idx, their place in another total order: a permutation and its inverse."""
    return numbered(numbered(rows, names, "orig_idx"), order, "sorted_idx")


def zipped(a: DataFrame, a_order: list, b: DataFrame, b_order: list) -> DataFrame:
    """Rows of two tables side by side by their place; tables of different lengths are an error."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return numbered(a, a_order).join(numbered(b, b_order), "rn").drop("rn")


def first_frames(rows: DataFrame, order: list, most: int | None) -> DataFrame:
    """The first frames in order, all without a limit."""
    return rows if most is None else rows.orderBy(*order).limit(most)


def stride_sample(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Every n-th row, n = rows / most cut off (1 at least), at most ``most`` of them."""
    step = max(1, rows.count() // most)
    return numbered(rows, order).where((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < most))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same on every run: those of the least hashes of their key."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def drop_blurred(rows: DataFrame, score: str, order: str, percent: float) -> DataFrame:
    """Rows without the given share of least score (cut off; negative scores stay), renamed in order."""
    n = int(rows.where(F.col(score) >= 0).count() * percent / 100)
    worst = numbered(rows.where(F.col(score) >= 0).select(score, order), [score, order]).where(F.col("rn") < n).select(order)
    return numbered(rows.join(worst, order, "left_anti"), [order], "new_index").withColumn("new_name", F.format_string("frame_%04d", F.col("new_index")))


def first_value(label: Column, table: dict[str, str], other: str) -> Column:
    """The value of the first key that holds the label or that it holds, whatever their case; else the other one."""
    low = F.lower(label)
    return F.coalesce(*(F.when(low.contains(k) | F.lit(k).contains(low), v) for k, v in table.items()), F.lit(other))


def first_label(labels: list[str]) -> Column:
    """For the column ``phrase``: the first label that holds it or that it holds; else the first that holds one of its words."""
    phrase = F.lower(F.col("phrase"))
    whole = [F.when(F.lit(x).contains(phrase) | phrase.contains(x), x) for x in labels]
    held = lambda label: F.exists(F.split(phrase, " "), lambda w: F.lit(label).contains(w))
    part = [F.when(held(x), x) for x in labels]
    return F.coalesce(*whole, *part)
