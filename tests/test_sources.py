"""Readers and writers on small files."""

import struct

import pytest
from pyspark.sql import functions as F

from roomweave.sources import ply, poses

ASCII = """ply
format ascii 1.0
comment made here
element face 1
property list uchar int vertex_indices
element vertex 2
property float x
property float y
property float z
property uchar red
end_header
3 0 1 1
1 2 3 255
-1.5 0 0.25 7
"""


def test_ascii(spark, tmp_path):
    (tmp_path / "a.ply").write_text(ASCII)
    rows = ply.read_ply(spark, str(tmp_path)).orderBy("row").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1.0, 2.0, 3.0, 255), (1, -1.5, 0.0, 0.25, 7)]
    got = ply.coloured(ply.read_ply(spark, str(tmp_path)), 128).orderBy("row").select("red", "green").collect()
    assert [tuple(r) for r in got] == [(255, 128), (7, 128)]


def test_big_endian_after_lists(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement face 2\nproperty list uchar short v\nelement vertex 1\nproperty double x\nproperty ushort n\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + struct.pack(">B2h", 2, 1, 2) + struct.pack(">B", 0) + struct.pack(">dH", 0.1, 65535))
    assert [tuple(r)[1:] for r in ply.read_ply(spark, str(tmp_path)).collect()] == [(0, 0.1, 65535)]


def test_cut_short_and_unknown(spark, tmp_path):
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nend_header\n1234")
    with pytest.raises(Exception, match="cut short"):
        ply.read_ply(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no element"):
        ply.read_ply(spark, str(tmp_path), "edge")


def test_round_trip(spark, tmp_path):
    made = spark.range(1000).select(F.col("id").cast("float").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 256).cast("int").alias("red"))
    parts = ply.ply_parts(made.repartition(3), {"x": "float", "red": "uchar"}).collect()
    assert sum(p.n_rows for p in parts) == 1000 and len({p.file for p in parts}) == len(parts)
    for p in parts:
        (tmp_path / p.file).write_bytes(p.content)
    got = ply.read_ply(spark, str(tmp_path)).select("x", "red")
    assert sorted(map(tuple, got.collect())) == sorted((r.x, r.red or 0) for r in made.collect())


def test_trajectory(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n\n1.5  1 2 3 0 0 0 2\n2 1 2\n3 0 0 0 0 0 0 0 extra\n")
    rows = poses.trajectory_matrices(poses.read_trajectory(spark, str(tmp_path))).orderBy("ts").collect()
    assert [r.ts for r in rows] == [1.5, 3.0]
    assert rows[0].cam_to_world == [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    assert rows[1].cam_to_world is None


def test_pose_json(spark, tmp_path):
    turn = [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    import json

    (tmp_path / "a.json").write_text(json.dumps({"a": {"cam_to_world_4x4": turn}, "b": {"extrinsic_4x4": turn}, "c": {}}))
    (tmp_path / "b.json").write_text(json.dumps({"fl_x": 1, "frames": [{"file_path": "f", "transform_matrix": turn}]}))
    got = {r.name: r.cam_to_world for r in poses.read_pose_json(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "f"] and got["a"] == got["f"] == turn
    assert got["b"] == [[0, 1, 0, -2], [-1, 0, 0, 1], [0, 0, 1, -3], [0, 0, 0, 1]]
