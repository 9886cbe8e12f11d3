"""Splats as surfaces, normal position, safest paths, hooks, image headers, cameras from several files, boxes and documents."""

import itertools
import json
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomweave.operators import crops, frames
from roomweave.operators import images as pixels_of
from roomweave.operators import masks, models, routes, scene, splats, voxels, world
from roomweave.plans import queries
from roomweave.sources import cameras, colmap, images, semantics


def matrix(w, x, y, z):
    n = math.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_inflate(spark, monkeypatch):
    """Grids of rotated splats in pieces of any size, small ones, one point a side, zero rotations, nulls, the cap of a side."""
    rng = np.random.default_rng(1)
    rows = [(k, *rng.normal(size=3).tolist(), rng.normal(-2.5, 1, 3).tolist(), rng.normal(size=4).tolist(), f"c{k}") for k in range(60)]
    rows += [(60, 0.0, 0.0, 0.0, [0.0, 0.0, 0.0], [0.0] * 4, "still"), (61, 1.0, 1.0, 1.0, [-1.0, -9.0, -9.0], [1.0, 0.0, 0.0, 0.0], "line"), (62, 0.0, 0.0, 0.0, [3.0, 3.0, 3.0], [1.0, 0.0, 0.0, 0.0], "huge"), (63, 2.0, 2.0, 2.0, None, None, "bare")]
    table = spark.createDataFrame(rows, "pid long, x double, y double, z double, scale array<double>, rot array<double>, colour string")
    want = {}
    for k, x, y, z, scale, rot, colour in rows:
        s = sorted(map(math.exp, scale), reverse=True) if scale else [0, 0]
        n0, n1 = (min(20, max(1, math.ceil(2 * v / 0.1))) for v in s[:2])
        if s[0] < 0.15 or n0 * n1 <= 1 or not rot or not any(rot):
            want[k, 0] = (x, y, z, colour)
            continue
        r = matrix(*rot)
        u, v = (np.linspace(-a, a, n) if n > 1 else np.array([-a]) for a, n in zip(s, (n0, n1)))
        for i in range(n0 * n1):
            want[k, i] = (*(np.array([x, y, z]) + r[:, 0] * u[i % n0] + r[:, 1] * v[i // n0]), colour)
    for piece in (7, 4096):
        monkeypatch.setattr(splats, "PIECE", piece)
        got = {(r.pid, r["sample"]): (r.x, r.y, r.z, r.colour) for r in splats.inflate(table, "pid", 0.1, 0.15, most=20, keep=["colour"]).collect()}
        assert got.keys() == want.keys() and all(got[k][3] == want[k][3] and np.allclose(got[k][:3], want[k][:3]) for k in want)
    assert sum(1 for k in want if k[0] == 62) == 400 and sum(1 for k in want if k[0] == 61) == 8
    inside = splats.within_bounds(splats.inflate(table, "pid", 0.1, 0.15, most=20), table)
    xyz = np.array([r[1:4] for r in rows])
    lo, hi = xyz.min(0), xyz.max(0)
    assert inside.count() == sum(bool(np.all((np.array(p[:3]) >= lo - 0.2 * (hi - lo)) & (np.array(p[:3]) <= hi + 0.2 * (hi - lo)))) for p in want.values())
    logits = spark.createDataFrame([(0.0,), (-3.0,), (5.0,)], "opacity double")
    assert splats.opaque(logits, 0.5).count() == 2 and splats.opaque(logits, 0.5, strict=True).count() == 1


def test_normal_position(spark):
    """A random turn, move and scale of everything ends in the same place; the transform is the one applied."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 3)) * [3, 2, 1] + rng.exponential(size=(300, 3))
    look = [matrix(*rng.normal([1, 0.2, 0.1, 0.1], 0.15)) for _ in range(40)]
    at = rng.normal(size=(40, 3)) + [0, 0, -4]
    ends = []
    for scale, turn, move in ((1.0, np.eye(3), np.zeros(3)), (2.5, matrix(0.3, -0.5, 0.8, 0.1), np.array([3.0, -7.0, 11.0]))):
        p, c, r = scale * points @ turn.T + move, scale * at @ turn.T + move, [turn @ x for x in look]
        cams = spark.createDataFrame([(k, *c[k].tolist(), r[k].ravel().tolist()) for k in range(40)], "id int, x double, y double, z double, r array<double>")
        table = spark.createDataFrame([(k, *p[k].tolist()) for k in range(300)], "id int, x double, y double, z double")
        new_cams, new_points, transform = world.normalised(cams, table)
        got = np.array([tuple(x)[1:] for x in new_points.orderBy("id").collect()])
        assert np.allclose(got, p @ transform[:3, :3].T + transform[:3, 3])
        turned = [np.array(x.r).reshape(3, 3) for x in new_cams.orderBy("id").collect()]
        assert all(np.allclose(x @ x.T, np.eye(3)) for x in turned)
        ends.append((got, turned))
    assert np.allclose(ends[0][0], ends[1][0], atol=1e-6) and np.allclose(ends[0][1], ends[1][1], atol=1e-6)
    spread = np.cov(ends[0][0].T)
    assert np.allclose(spread, np.diag(np.diag(spread)), atol=1e-8) and spread[0, 0] > spread[1, 1] > spread[2, 2]
    assert (world.from_points(table.limit(10)) == np.eye(4)).all() and (world.from_cameras(cams.limit(0)) == np.eye(4)).all()


def test_safest_path(spark):
    """Small graphs with equal confidences, loops, double links and parts against all simple paths."""
    chance = random.Random(2)
    for n in (1, 5, 8):
        conf = {k: chance.choice([0.1, 0.4, 0.4, 0.9]) for k in range(n)}
        links = [(chance.randrange(n), chance.randrange(n)) for _ in range(2 * n - 1)]
        nodes = spark.createDataFrame(list(conf.items()), "id int, conf double").checkpoint()
        edges = spark.createDataFrame(links, "a int, b int").checkpoint()
        near = {k: {b for a, b in links if a == k} | {a for a, b in links if b == k} for k in range(n)}

        def best(at, goal, held, low):
            if at == goal:
                return low
            return max((best(b, goal, held | {b}, min(low, conf[b])) for b in near[at] - held), default=-1)

        for start, goal in [(0, 0), (0, n - 1), (n // 2, 0)]:
            way = sorted(map(tuple, routes.safest_path(nodes, edges, start, goal).collect()))
            want = best(start, goal, {start}, conf[start])
            if want < 0:
                assert way == []
                continue
            assert [s for s, *_ in way] == list(range(len(way))) and way[0][1] == start and way[-1][1] == goal and min(c for *_, c in way) == want
            assert all(b in near[a] for (_, a, _), (_, b, _) in itertools.pairwise(way)) and len({i for _, i, _ in way}) == len(way)
    assert routes.safest_path(nodes, edges, 0, 99).count() == 0


def test_hooks(spark):
    """A made-up detector through the hook, into painted masks; a model is loaded once a process; other columns are an error."""
    frames_ = spark.createDataFrame([(k, 10, 8) for k in range(20)], "frame int, width int, height int").repartition(4)

    def detect(model, batch):
        return pd.DataFrame({"frame": batch.frame, "ord": 0, "class_idx": 1 + batch.frame % 3, "x": 1.0, "y": 1.0, "w": 4.0, "h": 2.0, "conf": model["conf"], "mask_height": None, "mask_width": None, "counts": None})

    schema = "frame int, ord int, class_idx int, x double, y double, w double, h double, conf double, mask_height int, mask_width int, counts string"
    found = models.apply_model(frames_, "boxes", lambda: {"conf": 0.9}, detect, schema)
    pixels = frames_.select("frame", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("pid")).select("frame", "pid", (F.col("pid") % 10).alias("u"), F.floor(F.col("pid") / 10).cast("int").alias("v"))
    got = masks.look_up(pixels, masks.label_runs(found, 8, 10)).collect()
    assert len(got) == 20 * 8 and all(r.class_idx == 1 + r.frame % 3 for r in got)

    def loads():
        models.calls = getattr(models, "calls", 0) + 1
        return models.calls

    many = models.apply_model(spark.range(0, 100, 1, 6), "counted", loads, lambda m, b: pd.DataFrame({"loaded": [m] * len(b)}), "loaded int")
    assert {r.loaded for r in many.collect()} == {1}
    with pytest.raises(Exception, match="returned"):
        models.apply_model(spark.range(3), "odd", lambda: 1, lambda m, b: pd.DataFrame({"other": b.id}), "loaded int").collect()


def jpeg(width, height, orientation=None, order=">", padding=b""):
    exif = b""
    if orientation:
        tiff = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x10JFIF" + b"\0" * 10 + exif + b"\xff\xff\xfe\0\x06note" + padding + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", height, width) + b"\3" + b"\0" * 9 + b"\xff\xda"


def png(width, height, orientation=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    exif = chunk(b"eXIf", b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)) if orientation else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + exif + chunk(b"IDAT", b"")


def test_image_headers(spark, tmp_path):
    """Both formats, all orientations in either byte order, odd and cut files; intrinsics and boxes for the size found."""
    want = {}
    for k in range(1, 9):
        shown = (200, 300) if k >= 5 else (300, 200)
        for name, data in ((f"j{k}.jpg", jpeg(300, 200, k, "<>"[k % 2])), (f"p{k}.png", png(300, 200, k))):
            (tmp_path / name).write_bytes(data)
            want[name] = (name[-3:].replace("jpg", "jpeg"), 300, 200, k, *shown)
    for name, data in (("plain.jpg", jpeg(7, 5)), ("plain.png", png(7, 5))):
        (tmp_path / name).write_bytes(data)
        want[name] = (name[-3:].replace("jpg", "jpeg"), 7, 5, 1, 7, 5)
    for name, data in (("text.jpg", b"hello"), ("cut.jpg", jpeg(7, 5)[:30]), ("cut.png", png(7, 5)[:12])):
        (tmp_path / name).write_bytes(data)
        want[name] = (None,) * 6
    (tmp_path / "empty.png").write_bytes(b"")  # not listed
    sizes = images.read_sizes(spark, str(tmp_path))
    assert {r.name: (r.kind, r.stored_width, r.stored_height, r.orientation, r.width, r.height) for r in sizes.collect()} == want
    held = spark.createDataFrame([("j1.jpg", 150, 400, 10.0, 20.0, 75.0, 200.0), ("j6.jpg", 100, 100, 10.0, 10.0, 50.0, 50.0), ("none.jpg", 5, 5, 1.0, 1.0, 1.0, 1.0), ("cut.jpg", 5, 5, 1.0, 1.0, 1.0, 1.0)], "name string, width int, height int, fx double, fy double, cx double, cy double")
    got = {r.name: tuple(r)[1:] for r in images.rescaled(held, sizes).collect()}
    assert got == {"j1.jpg": (300, 200, 20.0, 10.0, 150.0, 100.0), "j6.jpg": (200, 300, 20.0, 30.0, 100.0, 150.0), "none.jpg": (5, 5, 1.0, 1.0, 1.0, 1.0), "cut.jpg": (5, 5, 1.0, 1.0, 1.0, 1.0)}
    box = images.rescaled_box(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.lit(10), F.lit(10), F.lit(20), F.lit(5))
    assert spark.range(1).select(box).first()[0] == [2.0, 1.0, 6.0, 2.0]


def test_cameras(spark, tmp_path):
    """The first file with a camera wins, whatever lies in later ones; lines of seven and eight words."""
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    folders = [str(tmp_path / "missing"), str(tmp_path / "a"), str(tmp_path / "b")]
    assert cameras.first_cameras(spark, folders) == (None, None)
    (tmp_path / "b" / "room_video.txt").write_text("# comment\n\nkf7 1 2 3 0 0 0 2\n4 5 6 0 0 1 0\nfive words are too few\nx 1 2 3 q 0 0 1\n7 8 9 0 0 0 0\n")
    path, found = cameras.first_cameras(spark, folders)
    rows = {r.frame: r for r in found.collect()}
    assert path.endswith("b/room_video.txt") and set(rows) == {"kf7", "1", "x", "4"}
    assert tuple(rows["kf7"])[1:4] == (1, 2, 3) and rows["kf7"].r == [1, 0, 0, 0, 1, 0, 0, 0, 1] and rows["kf7"].fx == 600 and rows["1"].r[:5] == [-1, 0, 0, 0, -1] and rows["x"].r[0] is None and rows["4"].r[0] is None
    pose = [[0, -1, 0, 5], [1, 0, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]
    (tmp_path / "b" / "camera_poses.json").write_text(json.dumps({"f2.jpg": {"cam_to_world_4x4": pose, "intrinsic_3x3": [[9, 0, 3], [0, 8, 2], [0, 0, 1]]}, "f1.jpg": {"cam_to_world_4x4": pose}, "f3.jpg": {"cam_to_world_4x4": pose[:3], "intrinsic_3x3": pose[:3]}}))
    path, found = cameras.first_cameras(spark, folders)
    assert path.endswith("camera_poses.json") and [tuple(r) for r in found.collect()] == [("f2", 5, 6, 7, [0, -1, 0, 1, 0, 0, 0, 0, 1], 9, 8, 3, 2)]
    (tmp_path / "a" / "transforms.json").write_text(json.dumps({"frames": []}))
    assert cameras.first_cameras(spark, folders)[0].endswith("camera_poses.json")
    (tmp_path / "a" / "transforms.json").write_text(json.dumps({"fl_x": 4, "cx": 1, "cy": 2, "w": 3, "h": 4, "frames": [{"file_path": "i/x.png", "transform_matrix": pose}]}))
    path, found = cameras.first_cameras(spark, folders)
    row = found.first()
    assert path.endswith("a/transforms.json") and (row.frame, row.x, row.y, row.z, row.fx, row.fy) == ("x", 5, 6, 7, 4, 4) and np.allclose(np.array(row.r).reshape(3, 3), np.array(pose)[:3, :3] @ np.diag([1, -1, -1]))


def test_boxes_and_documents(spark, tmp_path):
    rows = [(0, "a", None, None, None, [0.0, 0.0, 0.0, 2.0, 4.0, 6.0]), (1, "b", [9.0, 9.0, 9.0], [1.0, 1.0, 1.0], [2.0, 2.0, 2.0], []), (2, "c", None, [1.0, 1.0], [2.0, 2.0, 2.0], None), (3, "d", [1.0], None, None, [0.0, 0.0])]
    objects = spark.createDataFrame(rows, "ord int, label string, centroid_3d array<double>, bbox_min array<double>, bbox_max array<double>, bbox_3d array<double>")
    got = {r.label: (r.box, r.centre) for r in scene.with_boxes(objects).collect()}
    assert got == {"a": ([0, 0, 0, 2, 4, 6], [1, 2, 3]), "b": ([1, 1, 1, 2, 2, 2], [9, 9, 9]), "c": (None, None), "d": (None, None)}
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 1, 0.5)], "i int, j int, k int, confidence double")
    shape = spark.createDataFrame([(0.0, 0.0, 0.0, 8, 8, 8)], "ox double, oy double, oz double, nx int, ny int, nz int")
    sure = {r.label: (r.reconstruction_confidence, r.provenance) for r in scene.object_confidence(objects, cells, shape, 1.0).collect()}
    assert sure == {"a": (round(1.5 / (3 * 5 * 7), 4), "inferred"), "b": (round(0.5 / 8, 4), "inferred"), "c": (0.0, "inferred"), "d": (0.0, "inferred")}
    made = []
    build = lambda: made.append(1) or spark.createDataFrame([('{"nodes": [1, 2]}',)], "document string")
    for _ in range(2):
        assert json.loads(scene.read_document(spark, str(tmp_path / "g.json"), build).first()[0]) == {"nodes": [1, 2]} and made == [1]
    asked = scene.prompts(scene.read_document(spark, str(tmp_path / "g.json"), build), ["Where?", "Why?"]).collect()
    assert [r.message for r in asked] == ["Where?", "Why?"] and all('{"nodes":[1,2]}' in r.prompt for r in asked)
    (tmp_path / "m.json").write_text('{"pct_medium": 34.5, "odd": "x"}')
    assert [scene.read_share(spark, str(tmp_path / n), f) for n, f in (("m.json", "pct_medium"), ("m.json", "odd"), ("none.json", "pct_medium"))] == [34.5, 0.0, 0.0]
    nodes = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.5)], "ord int, reconstruction_confidence double")
    assert [r.ord for r in scene.by_confidence(nodes).collect()] == [1, 0, 2]


def test_two_chairs(spark):
    """Objects of one label are one thing to each other: no relation between three names it twice, and none is near itself."""
    at = [("chair", 0.0), ("chair", 1.0), ("desk", 0.5), ("door", 0.6)]
    nodes = spark.createDataFrame([(k, n, x, 0.0, 0.0, x - 0.1, -0.1, -0.1, x + 0.1, 0.1, 0.1) for k, (n, x) in enumerate(at)], "ord int, label string, x double, y double, z double, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    got = scene.edges(nodes).collect()
    between = sorted((r.source, r.target_1, r.target_2) for r in got if r.relation == "between")
    want = sorted((a[0], b[0], c[0]) for b, c in itertools.combinations(at, 2) for a in at if a[0] not in (b[0], c[0]) and min(b[1], c[1]) <= a[1] <= max(b[1], c[1]))
    assert between == want and len([r for r in got if r.relation == "next_to"]) == 5


def test_small_ones(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a")], "i int, x string"), spark.createDataFrame([(20,), (10,)], "y int")
    assert sorted((r.x, r.y) for r in frames.zipped(a, ["i"], b, ["y"]).collect()) == [("a", 10), ("c", 20)]
    with pytest.raises(ValueError):
        frames.zipped(a, ["i"], b.limit(1), ["y"])
    assert [r.y for r in frames.first_frames(b, ["y"], 1).collect()] == [10] and frames.first_frames(b, ["y"], None).count() == 2
    colour = frames.first_value(F.col("x"), {"table": "#1", "tablecloth": "#2", "sofa": "#3"}, "#0")
    assert [r.c for r in spark.createDataFrame([("Tablecloth",), ("fa",), ("lamp",)], "x string").select(colour.alias("c")).collect()] == ["#1", "#3", "#0"]
    points = spark.createDataFrame([(float(k),) for k in range(1, 6)], "conf double")
    assert crops.sure_enough(points, "conf", 4.0).count() == 2 and crops.sure_enough(points, "conf", 9.0).count() == 3 and crops.sure_enough(points.limit(0), "conf", 1.0).count() == 0
    cells = voxels.topdown(spark.createDataFrame([(0.0, 0.0, 10, 20, 30), (0.01, 0.0, 20, 20, 31), (1.0, 2.0, 0, 0, 0)], "x double, z double, red int, green int, blue int")).collect()
    assert sorted(tuple(r) for r in cells) == [(0, 0, 2, 15, 20, 30, 255), (20, 40, 1, 0, 0, 0, 160)]


def test_dataset_and_poses(spark, tmp_path):
    views = [(k, 1.0, 0.0, 0.0, 0.0, float(k), 2.0, 3.0, 1 + k % 2, f"{9 - k}.jpg", []) for k in range(10)]
    held = spark.createDataFrame([(1, "PINHOLE", 640, 480, [5.0, 6.0, 7.0, 8.0])], colmap.CAMERA)
    got = colmap.dataset(spark.createDataFrame(views, colmap.IMAGE), held, every=4).orderBy("index").collect()
    assert [(r["index"], r.name, r.split, r.cx_w, r.fx) for r in got] == [(i, f"{n}.jpg", "test" if i % 4 == 0 else "train", -float(9 - n), 5.0) for i, n in enumerate((1, 3, 5, 7, 9))]
    (tmp_path / "frame_01.json").write_text('{"desk": {"bbox": [0, 0, 1, 1], "confidence": 0.5}}')
    (tmp_path / "frame_02.json").write_text('{"desk": {"bbox": [0, 0, 1, 1], "confidence": 0.5}}')
    poses = spark.createDataFrame([("images/frame_01.jpg", 1), ("frame_03.png", 3)], "name string, at int")
    assert [(r.stem, r.label, r.at) for r in semantics.with_poses(semantics.read_semantics(spark, str(tmp_path)), poses).collect()] == [("frame_01", "desk", 1)]


def test_commands(spark, sf_dir, tmp_path, capsys):
    """Settings from the line, a file and the usual ones; each command on small files."""
    from roomweave.__main__ import main
    from roomweave.settings import Settings, read_settings
    from roomweave.sinks import ply as ply_sink

    (tmp_path / "c.json").write_text('{"confidence": {"voxel_size": 0.5, "camera_range": 2}, "min_zone_voxels": 7, "other": "x"}')
    assert read_settings(None) == Settings() and read_settings(str(tmp_path / "c.json"), {"voxel_size": 0.25, "camera_range": None}) == Settings(voxel_size=0.25, camera_range=2.0, min_zone_voxels=7)
    with pytest.raises(ValueError):
        read_settings(str(tmp_path / "c.json"), {"voxel_size": "wide"})
    main(["list"])
    assert "confidence_map" in capsys.readouterr().out.split()
    main(["run", "room_summary", sf_dir, str(tmp_path / "room")])
    assert spark.read.parquet(str(tmp_path / "room")).count() == 1
    cloud = spark.range(200).select(*((F.col("id") % n / 10.0).alias(c) for c, n in zip("xyz", (7, 11, 13))), *(F.lit(1).alias(c) for c in ("red", "green", "blue")))
    ply_sink.write_ply(cloud, str(tmp_path / "a.ply"))
    (tmp_path / "p.json").write_text(json.dumps({"frames": [{"file_path": "a", "transform_matrix": [[1, 0, 0, 0.3], [0, 1, 0, 0.5], [0, 0, 1, -1.0], [0, 0, 0, 1]]}]}))
    main(["confidence", str(tmp_path / "a.ply"), str(tmp_path / "p.json"), str(tmp_path / "conf"), "--config", str(tmp_path / "c.json")])
    found = spark.read.parquet(str(tmp_path / "conf"))
    assert found.count() > 10 and found.agg(F.max("confidence")).first()[0] <= 1.0
    (tmp_path / "o.json").write_text(json.dumps({"desk": {"centroid_3d": [0, 0, 0], "bbox_min": [0, 0, 0], "bbox_max": [1, 1, 1]}, "lamp": {"centroid_3d": [0.1, 0, 0], "bbox_min": [0, 0, 0], "bbox_max": [1, 1, 1]}}))
    main(["graph", str(tmp_path / "o.json"), str(tmp_path / "g.json")])
    graph = json.loads((tmp_path / "g.json").read_text())
    assert [e["relation"] for e in graph["edges"]] == ["next_to"] and len(graph["nodes"]) == 2


def test_scaled_boxes():
    e = {"class_idx": 3, "conf": 0.9, "ord": 0, "x": 1.0, "y": 1.0, "w": 2.0, "h": 1.0, "mask_height": 4, "mask_width": 5, "counts": None}
    for scale, want in ((False, masks.box_mask(1, 1, 2, 1, 8, 20)), (True, masks.box_mask(4, 2, 8, 2, 8, 20))):
        assert (masks.paint_image([e], 8, 20, 0.25, 0.3, 0, scale) == 3 * want).all()


def test_most_alike(spark, monkeypatch):
    """Several blocks, equal histograms, a flat one, fewer frames than asked for, against the whole matrix."""
    rng = np.random.default_rng(4)
    rows = {k: rng.dirichlet(np.full(64, 0.05)) for k in range(60)} | {70: np.full(64, 1 / 64)}
    rows[61] = rows[60 - 1]
    shares = spark.createDataFrame([(k, b, float(x)) for k, v in rows.items() for b, x in enumerate(v) if x > 0], "frame long, bin int, share double")
    want = []
    for a, x in rows.items():
        score = [(-round(float(np.corrcoef(x, y)[0, 1]), 9), b) for b, y in rows.items() if b != a and 70 not in (a, b)]
        want += [(a, rank, b, -s) for rank, (s, b) in enumerate(sorted(score)[:4], 1)]
    for block in (7, 2048):
        monkeypatch.setattr(pixels_of, "BLOCK", block)
        got = sorted(tuple(r) for r in pixels_of.most_alike(shares, 4).collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])
    assert pixels_of.most_alike(shares.where("frame < 2"), 5).count() == 2 and pixels_of.most_alike(shares.limit(0), 3).count() == 0


def test_numbers_of_more_digits(spark, tmp_path):
    """Frame numbers beyond the digits of a name are cut as the SQL cuts them."""
    import duckdb

    keys = [3, 999, 1234, 9999, 12345, 12349, 45678, 123456, None]
    spark.createDataFrame([(k, i, s) for k in range(3) for i, s in enumerate(keys)], "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(s,) for s in [*keys, 4567, 12]], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.SQL["frame_number_join"]).fetchall()
    assert sorted(map(tuple, queries.frame_number_join(spark, str(tmp_path)).select("frame_num", "n").collect())) == sorted(want) and want
