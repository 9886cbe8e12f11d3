"""Rotations, paths and numbering against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomweave.functions import camera, geometry
from roomweave.operators import frames, masks, neighbours, paths
from roomweave.plans import queries


def values(spark, columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def lits(v):
    return [F.lit(float(x)) for x in v]


@pytest.mark.parametrize("q", [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0.5, -0.5, 0.5, 0.5), (0.1, 0.9, -0.3, 0.2), (0.1, 0.2, 0.9, -0.3), (0.05, -0.3, 0.2, 0.9)])
def test_quaternions(spark, q):
    q = np.array(q, float) / np.linalg.norm(q)
    got = np.array(values(spark, camera.matrix_quaternion(geometry.quaternion_matrix(*lits(q)))))
    assert np.allclose(got, q, atol=1e-9) or np.allclose(got, -q, atol=1e-9)


def test_rotation_between(spark):
    for a, b in (((1, 0, 0), (0, 2, 0)), ((1, 2, 3), (-2, 0.5, 1)), ((0, 0, 1), (0, 0, -1)), ((1, 0, 0), (-3, 0, 0)), ((0, 1, 0), (0, 5, 0))):
        r = np.array(values(spark, camera.rotation_between(lits(a), lits(b)))).reshape(3, 3)
        assert np.allclose(r @ r.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(r), 1)
        assert np.allclose(r @ (np.array(a) / np.linalg.norm(a)), np.array(b) / np.linalg.norm(b), atol=1e-9)


def test_look_at_and_centre(spark):
    r, t = camera.look_at(lits((1, 2, 3)), lits((4, 2, 3)), lits((0, -1, 0)))
    m, t0 = np.array(values(spark, r)).reshape(3, 3), np.array(values(spark, t))
    assert np.allclose(m @ (4, 2, 3) + t0, (0, 0, 3)) and np.allclose(values(spark, camera.centre(r, t)), (1, 2, 3))
    assert np.allclose(values(spark, camera.turn_about(lits((1, 0, 0)), lits((0, 0, 1)), F.lit(math.pi / 2))), (0, 1, 0))


def test_colours(spark):
    assert values(spark, camera.hex_bytes(F.lit("#FFb6C1"))) == [255, 182, 193]
    assert values(spark, [camera.dimmed(F.lit(99), F.lit(False)), camera.dimmed(F.lit(99), F.lit(True)), geometry.sigmoid(F.lit(-900.0), 20.0)]) == [29, 99, pytest.approx(2.06e-9, rel=1e-2)]
    assert values(spark, camera.quaternion_bytes(lits((0, 0, 0, 0)))) == [127] * 4
    assert values(spark, camera.tinted(lits((0, 0, 0)), [F.lit(255)] * 3, F.lit(True))) == pytest.approx([0.18 * 0.5 / geometry.SH_C0] * 3)
    assert values(spark, [camera.clamped_pixel(F.lit(3), F.lit(640)), camera.clamped_pixel(F.lit(700), F.lit(640)), camera.clamped_pixel(F.lit(None).cast("int"), F.lit(640))]) == [50, 590, 320]


def test_turning_between_keys(spark):
    """Keys at 0 and 10, a quarter turn apart by the shorter arc; nearly equal keys, and rows beyond the ends."""
    h = math.sqrt(0.5)
    rows = [("a", -5, 0.0, None), ("a", 0, 0.0, (1.0, 0.0, 0.0, 0.0)), ("a", 4, None, None), ("a", 10, 10.0, (-h, -h, 0.0, 0.0)), ("a", 15, None, None)]
    df = spark.createDataFrame([(t, o, x, *(q or (None,) * 4)) for t, o, x, q in rows], "track string, at int, x double, qw double, qx double, qy double, qz double")
    got = {r.at: r for r in frames.as_of(df, "track", "at", F.col("qw").isNotNull(), ["x"], ["qw", "qx", "qy", "qz"]).collect()}
    assert [got[k].how for k in (-5, 0, 4, 10, 15)] == ["clamped", "exact", "between", "exact", "clamped"]
    assert got[4].x == pytest.approx(4.0) and (got[4].qw, got[4].qx) == pytest.approx((math.cos(math.pi / 10), math.sin(math.pi / 10)))
    assert abs(got[15].qw) == pytest.approx(h) and got[-5].qw == pytest.approx(1.0)


def test_paths(spark):
    assert [r.rn for r in paths.keyframes(spark.range(11).withColumnRenamed("id", "rn"), 11, 4).orderBy("rn").collect()] == sorted({round(x) for x in np.linspace(0, 10, 4)})
    keys = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 0.0)], "rn long, x double")
    got = paths.segments(keys, "rn", ["x"], 3, 8).orderBy("rn", "step").collect()
    assert [(r.rn, r.step, r.x) for r in got] == [(0, 0, 0.0), (0, 1, 2.5), (0, 2, 5.0), (0, 3, 7.5), (1, 0, 10.0), (1, 1, 7.5), (1, 2, 5.0), (1, 3, 2.5)]
    orbit = paths.orbit(spark, (1.0, 2.0, 3.0), 2.0, 4).orderBy("frame").collect()
    eyes = [-np.array(r.r).reshape(3, 3).T @ np.array(r.t) for r in orbit]
    assert len(orbit) == 4 and np.allclose([np.linalg.norm(e - (1, 2, 3)) for e in eyes], 2.0)
    assert all(np.allclose(np.array(r.r).reshape(3, 3) @ (1, 2, 3) + r.t, (0, 0, 2.0)) for r in orbit)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_numbers_of_many_rows(spark, coalesced):
    """400,000 rows with more columns over many ranges are numbered without gaps, also where ranges are coalesced."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        n = 400_000
        rows = spark.range(n).select((F.xxhash64("id")).alias("key"), "id", F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
        got = frames.numbered(rows, ["key", "id"])
        assert tuple(got.agg(F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn")).first()) == (n, n, 0, n - 1)
        assert frames.stride_sample(rows, ["id"], 300).agg(F.count("*"), F.sum("id")).first()[:] == (300, sum(range(0, 300 * 1333, 1333)))
        left = frames.drop_blurred(rows.withColumn("score", F.col("id") * 1.0), "score", "id", 10)
        assert left.agg(F.count("*"), F.min("id"), F.max("new_index")).first()[:] == (360_000, 40_000, 359_999)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_projection_in_blocks(spark):
    """Blocks before cameras lose no point that plain projection sees, with turned cameras."""
    rng = np.random.default_rng(3)
    p = rng.normal(0, 3, (500, 3))
    cams = []
    for k in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q = q * np.sign(np.linalg.det(q))
        cams.append((k, q.ravel().tolist(), *rng.normal(0, 2, 3).tolist(), 300.0, 310.0, 200.0, 150.0, 400, 300))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    cameras = spark.createDataFrame(cams, "frame int, r array<double>, tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int")
    want = set()
    for k, r, *t, fx, fy, cx, cy, w, h in cams:
        for i, (x, y, z) in enumerate(p @ np.array(r).reshape(3, 3).T + t):
            if z > 0.05:
                u, v = round(x / z * fx + cx), round(y / z * fy + cy)
                if 0 <= u < w and 0 <= v < h:
                    want.add((k, i, u, v))
    assert {tuple(r) for r in frames.project(points, cameras).collect()} == want and want


def _viewed(spark, places, cameras):
    points = spark.createDataFrame([(i, *map(float, x), f"k{i % 3}") for i, x in enumerate(places)], "pid long, x double, y double, z double, kind string")
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    poses = [(k, one, *map(float, t), 300.0, 300.0, 200.0, 150.0, 400, 300) for k, t in enumerate(cameras)]
    return points, spark.createDataFrame(poses, "frame int, r array<double>, tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int")


def test_projection_of_copies(spark, monkeypatch):
    """Points of one place, cameras of one pose, places that are missing, many packs, and more cameras than are broadcast."""
    rng = np.random.default_rng(5)
    p = np.repeat(rng.normal(0, 2, (90, 3)), 5, 0)
    p[7, 0], p[8, 2] = np.nan, np.inf
    t = np.repeat(rng.normal(0, 1, (6, 3)), 4, 0)
    points, cameras = _viewed(spark, p, t)
    points = points.unionByName(spark.createDataFrame([(None, 0.1, 0.1, 9.0, "none"), (-1, None, 0.0, 9.0, "no place")], points.schema))
    want = sorted((k, i, round(x / z * 300 + 200), round(y / z * 300 + 150), f"k{i % 3}") for k, s in enumerate(t) for i, (x, y, z) in enumerate(p + s) if np.isfinite([x, y, z]).all() and z > 0.05 and 0 <= round(x / z * 300 + 200) < 400 and 0 <= round(y / z * 300 + 150) < 300)
    for name, value in (("PART", 1024), ("PART", 16), ("VIEWS", 5), ("STRIP", 2), ("VIEWERS", 3)):
        monkeypatch.setattr(frames, name, value)
        got = [tuple(r) for r in frames.project(points, cameras, keep=("kind",)).collect()]
        assert sorted(r for r in got if r[1] is not None) == want and want
        assert sorted(r[0] for r in got if r[1] is None) == list(range(24))
    assert frames.project(points.limit(0), cameras).count() == frames.project(points, cameras.limit(0)).count() == 0


def test_projection_shuffles_points_only(spark):
    """What pairs of points and cameras make is neither shuffled nor written: only points and cameras are exchanged."""
    rng = np.random.default_rng(6)
    points, cameras = _viewed(spark, rng.normal(0, 2, (400, 3)), rng.normal(0, 1, (40, 3)))
    plan = frames.project(points, cameras)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len(exchanges) == 2 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_rectangles_and_weights(spark):
    """Runs become rectangles and points find the same classes in them; votes are weighed."""
    rng = np.random.default_rng(8)
    entries = [(k, i, 1 + i % 3, *map(float, rng.integers(-40, 380, 2)), *map(float, rng.integers(5, 120, 2)), 0.5, None, None, None) for k in range(3) for i in range(4)]
    runs = masks.label_runs(spark.createDataFrame(entries, "frame int, ord int, class_idx int, x double, y double, w double, h double, conf double, mask_height int, mask_width int, counts string"), 300, 400).checkpoint()
    points, cameras = _viewed(spark, rng.normal(0, 2, (2000, 3)), rng.normal(0, 1, (3, 3)))
    got = frames.project(points, cameras.join(masks.areas(runs), "frame"))
    want = masks.look_up(frames.project(points, cameras), runs)
    assert sorted(got.select("frame", "pid", "value").collect()) == sorted(want.collect()) and want.count() > 20
    rows = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (1, 1, 3), (2, 1, 1)], "pid int, class_idx int, n int")
    assert [tuple(r) for r in frames.vote(rows, 2, "n").collect()] == [(1, 1, 3, 5)] and [tuple(r) for r in frames.vote(rows, 2).collect()] == [(1, 2, 2, 3)]


def _rows_written(spark, sf_dir, monkeypatch, name):
    """The largest table that a query writes for itself."""
    sizes, written = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df: (t := written(df), sizes.append(t.count()))[0])
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    return max(sizes)


def test_votes_write_no_pixels(spark, sf_dir, monkeypatch):
    assert _rows_written(spark, sf_dir, monkeypatch, "E5_painted_votes") <= queries.evpts(spark, sf_dir).count()


def test_labels_write_no_pixels(spark, sf_dir, monkeypatch):
    assert _rows_written(spark, sf_dir, monkeypatch, "paint_labels") <= queries.evpts(spark, sf_dir).count()


def test_first_area(spark):
    """Of the boxes around a pixel the smallest, then the surest, then the last; frames without boxes have no labels."""
    rng = np.random.default_rng(7)
    points, cameras = _viewed(spark, np.repeat(rng.normal(0, 2, (600, 3)), 2, 0), rng.normal(0, 1, (5, 3)))
    rows = [(k, f"l{i}", *map(int, rng.integers(-20, 300, 2)), *map(int, rng.choice([80, 160], 2)), float(rng.choice([0.2, 0.3, 0.5])), 0.1 * int(i % 5), i) for k in range(4) for i in range(8)]
    boxes = spark.createDataFrame(rows, "frame int, label string, x int, y int, w int, h int, conf double, cover double, ord int")
    got = frames.project(points, cameras.join(frames.areas(boxes, 0.25, 0.3), "frame", "left")).select("frame", "pid", "value")
    want = set()
    for r in frames.project(points, cameras).collect():
        hit = [(w * h, -conf, -o, label) for k, label, x, y, w, h, conf, cover, o in rows if k == r.frame and conf >= 0.25 and cover <= 0.3 and x <= r.u < x + w and y <= r.v < y + h]
        if hit:
            want.add((r.frame, r.pid, min(hit)[-1]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def _nearest_plainly(zones, cameras):
    """Missing distances last, before them those that are no number; of equals the first camera."""
    want = {}
    for zone, *p in zones:
        order = []
        for camera, *q in cameras:
            # sum() would carry what is lost in rounding.
            d = None if None in p or None in q else math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]))
            order.append((d is None, d is not None and math.isnan(d), d if d is not None and not math.isnan(d) else 0.0, camera))
        none, odd, d, camera = min(order)
        want[zone] = (camera, None if none else "nan" if odd else d)
    return want


def test_nearest_camera(spark, monkeypatch):
    """Ties, copies of cameras and zones, places that are missing or not finite, a far zone, several packs, and more cameras than are broadcast."""
    rng = np.random.default_rng(9)
    inf, nan = math.inf, math.nan
    cameras = [(7 * k % 301, *map(float, p)) for k, p in enumerate([*rng.normal(0, 0.3, (200, 3)), *rng.integers(-2, 3, (100, 3))])]
    odd = [(400, None, 0.0, 0.0), (401, nan, 0.0, 0.0), (402, inf, 0.0, 0.0), (403, 1e200, 0.0, 0.0)]
    zones = [(k, *map(float, p)) for k, p in enumerate([*rng.normal(0, 3, (300, 3)), *rng.integers(-4, 5, (200, 3)) / 2, (1e7, 0, 0)])]
    zones += [(600, None, 0.0, 0.0), (601, nan, 0.0, 0.0), (602, inf, 0.0, 0.0), (603, -inf, 1.0, 0.0), (604, 1e200, 0.0, 0.0)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)

    def check(cameras):
        got = frames.nearest_camera(frame(zones, "zone int, x double, y double, z double"), frame(cameras, "camera int, cx double, cy double, cz double")).collect()
        assert {r.zone: (r.camera, "nan" if r.dist is not None and math.isnan(r.dist) else r.dist) for r in got} == _nearest_plainly(zones, cameras) and len(got) == len(zones)

    for some in (cameras, cameras + odd, odd, odd[:1], [(3, 0.1, 0.2, 0.3)]):
        check(some)
    for name, value in (("CAMERAS", 40), ("LEAF", 3), ("BRANCH", 2), ("TREES", 2), ("VIEWERS", 100)):
        monkeypatch.setattr(frames, name, value)
        check(cameras + odd)


def test_nearest_of_many_cameras():
    """A zone far from a cluster of cameras meets few of them: before, all distances were taken."""
    rng = np.random.default_rng(10)
    places, zones = rng.normal(0, 0.1, (8192, 3)), rng.normal(0, 3, (20_000, 3))
    met, sqrt = [], np.sqrt
    patch = pytest.MonkeyPatch()
    with patch.context() as m:
        m.setattr(np, "sqrt", lambda v: (met.append(v.size), sqrt(v))[1])
        best, dist = frames._Boxes(places).nearest(zones)
    want = np.sqrt(((zones[::500, None] - places) ** 2).sum(2))
    assert (best[::500] == want.argmin(1)).all() and np.allclose(dist[::500], want.min(1), rtol=1e-12)
    assert sum(met) < 0.1 * len(zones) * len(places)


def test_far_outlier(spark):
    """Neighbours of a point very far away are found too."""
    rows = [(i, i * 0.1, 0.0, 0.0) for i in range(6)] + [(9, 1e5, 0.0, 0.0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 2, 0.5)
    assert [r.other for r in got.where("pid = 9").orderBy("rank").collect()] == [5, 4] and got.count() == 14


def test_nearest_where_points_are_dense(spark):
    """A dense ball, a heap of copies, lone points and null ones, against all distances; few points; no points."""
    rng = np.random.default_rng(3)
    places = np.vstack([rng.normal(0, 1e-4, (700, 3)), np.tile([0.5, -2.0, 3.0], (300, 1)), rng.uniform(-50, 50, (150, 3)), rng.integers(0, 3, (60, 3)).astype(float)])
    schema = "pid long, x double, y double, z double"
    rows = [(int(i), *map(float, places[j])) for i, j in enumerate(rng.permutation(len(places)))]
    at = np.array([r[1:] for r in rows])
    for k in (1, 4):
        want = set()
        for i in range(len(rows)):
            d = at[i] - at
            order = np.lexsort((np.arange(len(rows)), np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])))
            want |= {(i, int(j), r + 1) for r, j in enumerate(order[order != i][:k])}
        got = neighbours.nearest(spark.createDataFrame([*rows, (9999, None, 0.0, 0.0)], schema).repartition(5), k)
        assert {(r.pid, r.other, r.rank) for r in got.collect()} == want and got.count() == len(want)
    few = neighbours.nearest(spark.createDataFrame(rows[:3], schema), 9)
    assert sorted((r.pid, r.rank) for r in few.collect()) == [(i, r) for i in range(3) for r in (1, 2)]
    assert not neighbours.nearest(spark.createDataFrame(rows[:1], schema), 2).count() and not neighbours.nearest(spark.createDataFrame([], schema), 2).count()
