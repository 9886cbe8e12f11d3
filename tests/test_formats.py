"""Reconstructions, splats, annotations and masks: round trips and small cases."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomweave.operators import masks
from roomweave.sources import colmap, ply, semantics, splat


def test_cameras(spark, tmp_path):
    rows = [(1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), (2, "SIMPLE_RADIAL", 10, 20, [5.0, 1.0, 2.0, 0.1]), (3, "OPENCV", 1, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])]
    made = spark.createDataFrame(rows, colmap.CAMERA).repartition(2)
    (tmp_path / "cameras.bin").write_bytes(colmap.file_bytes(colmap.file_parts(made, "cameras")))
    got = colmap.read_cameras(spark, str(tmp_path / "cameras.bin"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == rows
    assert [tuple(r) for r in got.orderBy("camera_id").select(*colmap.intrinsics()).collect()] == [(500, 501, 320, 240), (5, 5, 1, 2), (1, 2, 3, 4)]
    (tmp_path / "odd.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 7, 99, 3, 4, 1, 2, 3, 4))
    assert colmap.read_cameras(spark, str(tmp_path / "odd.bin")).first().model == "PINHOLE"


def test_images_and_points(spark, tmp_path):
    images = [(1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "a é.jpg", [(1.5, 2.5, 7), (3.0, 4.0, -1)]), (2, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 9, "b", [])]
    points = [(7, 1.0, 2.0, 3.0, 255, 0, 9, 0.5, [(1, 0), (2, 4)]), (8, 0.0, 0.0, 0.0, 1, 2, 3, 0.0, [])]
    for name, kind, schema, rows in (("images", "images", colmap.IMAGE, images), ("points", "points3D", colmap.POINT, points)):
        (tmp_path / name).write_bytes(colmap.file_bytes(colmap.file_parts(spark.createDataFrame(rows, schema), kind)))
    i, p = colmap.read_images(spark, str(tmp_path / "images")), colmap.read_points3d(spark, str(tmp_path / "points"))
    plain = lambda df, k: sorted((*tuple(r)[1:k], [tuple(x) for x in r[k]]) for r in df.collect())
    assert plain(i, 11) == images and plain(p, 9) == points
    assert [tuple(r) for r in colmap.observations(i, p).select("image_id", "u", "v", "point3d_id", "x").collect()] == [(1, 1.5, 2.5, 7, 1.0)]
    cameras = spark.createDataFrame([(1, "SIMPLE_PINHOLE", 6, 4, [5.0, 3.0, 2.0])], colmap.CAMERA)
    assert [(r.name, r.fy) for r in colmap.views(i, cameras).collect()] == [("a é.jpg", 5.0)]
    empty = colmap.file_bytes(colmap.file_parts(spark.createDataFrame([], colmap.POINT), "points3D"))
    (tmp_path / "none").write_bytes(empty)
    assert colmap.read_points3d(spark, str(tmp_path / "none")).count() == 0


def test_splats(spark, tmp_path):
    rows = [(float(k), 0.0, 1.0, [0.1 * k, -9.0, 9.0], float(k - 1), [float(x + k) for x in range(12)], [0.0, 1.0, -1.0], [2.0, 0.0, 0.0, 0.0] if k else [0.0] * 4) for k in range(3)]
    made = spark.createDataFrame(rows, "x float, y float, z float, f_dc array<float>, opacity float, f_rest array<float>, scale array<float>, rot array<float>")
    part = ply.ply_parts(splat.splat_columns(made, 12).coalesce(1), splat.splat_properties(12)).first()
    (tmp_path / "a.ply").write_bytes(part.content)
    got = splat.read_splats(spark, str(tmp_path / "a.ply")).orderBy("row")
    assert [r.f_rest for r in got.collect()] == [r[5] for r in rows]  # f_rest_10 comes after f_rest_9
    packed = splat.pack(got.coalesce(1)).first()
    assert packed.n_rows == 3 and len(packed.content) == 96
    for k, r in enumerate(rows):
        record = bytes(packed.content)[32 * k : 32 * k + 32]
        assert struct.unpack("<6f", record[:24]) == pytest.approx((*r[:3], *map(math.exp, r[6])), rel=1e-6)
        s = lambda x: 1 / (1 + math.exp(-x))
        want = [int(min(255, s(np.float32(c) * 0.28209479177387814 + 0.5) * 255)) for c in r[3]] + [int(s(r[4]) * 255)]
        assert list(record[24:28]) == want and list(record[28:]) == ([255, 127, 127, 127] if k else [127] * 4)
    bright = splat.pack(got, highlight=True, rgb=(1.0, 0.5, 0.0)).orderBy("part").collect()
    data = b"".join(bytes(r.content) for r in bright)
    assert [struct.unpack("<f", data[k : k + 4])[0] for k in range(0, 96, 32)] == [2.0, 1.0, 0.0] and list(data[24:28]) == [255, 127, 0, 255]


def test_run_lengths():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (60, 80), (300, 4)):
        for share in (0.0, 0.01, 0.5, 1.0):
            mask = rng.random(shape) < share
            assert (masks.decode_mask(masks.encode_mask(mask), *shape) == mask).all()
    assert masks.decode_mask("[2, 1, 3]", 3, 2).tolist() == [[False, False], [False, False], [True, False]]
    assert masks.encode_counts([0, 100_000, 3, 1, 2]) == masks.encode_counts(masks.decode_counts(masks.encode_counts([0, 100_000, 3, 1, 2])))


def test_erosion():
    mask = np.random.default_rng(2).random((30, 40)) < 0.97
    far = lambda v, u: all(0 <= a < 30 and 0 <= b < 40 and mask[a, b] for a in range(v - 2, v + 3) for b in range(u - 2, u + 3) if abs(a - v) + abs(b - u) <= 2)
    assert masks.erode(mask, 2).tolist() == [[far(v, u) for u in range(40)] for v in range(30)]
    assert int(masks.circle_mask(5, 5, 20, 20, 2).sum()) == 13 and masks.box_mask(-3, 1.9, 5.5, 2, 4, 4).sum() == 4


def test_painting(spark, tmp_path):
    """Small masks over large ones, empty masks by their box, unknown labels, doubtful and large ones left out; points looked up."""
    whole = np.zeros((10, 20), bool)
    whole[2:8, 2:12] = True
    rle = {"size": [10, 20], "counts": masks.encode_mask(whole)}
    none = {"size": [10, 20], "counts": masks.encode_mask(whole & False)}
    (tmp_path / "frame_0058.json").write_text(json.dumps({"desk": {"bbox": [0, 0, 1, 1], "confidence": 0.9, "mask_rle": rle}, "lamp": {"bbox": [4, 4, 3, 2], "confidence": 0.3, "mask_rle": none}, "cat": {"bbox": [0, 0, 20, 10], "confidence": 1},
                                                          "bed": {"bbox": [0, 0, 20, 10], "confidence": 0.9}, "fan": {"bbox": [2, 2, 2, 2], "confidence": 0.1}}))
    (tmp_path / "frame_00058.json").write_text("{}")
    (tmp_path / "other.json").write_text(json.dumps({"desk": {"bbox": [0, 0, 9, 9], "confidence": 0.9}}))
    read = semantics.read_semantics(spark, str(tmp_path))
    assert {r.stem: r.frame for r in read.collect()} == {"frame_0058": 58, "other": None}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in (("desk", 1), ("lamp", 2), ("bed", 3), ("fan", 4)) for x in pair)), F.col("label"))
    runs = masks.label_runs(semantics.last_of_number(read).withColumn("class_idx", number), 10, 20)
    image = np.zeros((10, 20), int)
    image[whole] = 1
    image[4:6, 4:7] = 2
    pixels = spark.createDataFrame([(58, 20 * v + u, u, v) for v in range(10) for u in range(20)], "frame int, pid long, u int, v int")
    got = {r.pid: r.class_idx for r in masks.look_up(pixels, runs).collect()}
    assert got == {20 * v + u: int(image[v, u]) for v, u in zip(*np.nonzero(image))}
    smaller = masks.label_runs(read.where("frame = 58").withColumn("class_idx", number), 10, 20, steps=1)
    assert sum(r.past - r.first for r in smaller.where("class_idx = 2").collect()) == 0 and smaller.count() > 0
