"""Images, picked files, probes, logs, arrays and transforms read from files."""

import json
import os

import numpy as np
import pytest

from roomweave.sources import files


def test_listing_and_picking(spark, tmp_path):
    for name, size in (("b.png", 5), ("a.png", 3), ("small.ply", 1), ("large.ply", 9), ("points.ply", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    folder = str(tmp_path)
    assert [r.name for r in files.list_images(spark, folder).collect()] == ["a.png", "b.png"]
    (tmp_path / "c.jpg").write_bytes(b"x")
    assert [r.name for r in files.list_images(spark, folder).collect()] == ["c.jpg"]
    os.utime(tmp_path / "small.ply", (2e9, 2e9))
    picked = lambda *a, **k: files.pick_file(spark, folder, *a, **k)
    assert picked("*.ply").endswith("/large.ply") and picked("*.ply", latest=True).endswith("/small.ply")
    assert picked("*.ply", ["none.ply", "points.ply", "small.ply"]).endswith("/points.ply") and picked("*.none") is None
    files.require_files(spark, folder, ["a.png", "small.ply"])
    with pytest.raises(FileNotFoundError, match="cameras.bin, images.bin"):
        files.require_files(spark, folder, ["cameras.bin", "a.png", "images.bin"])


def test_probes(spark, tmp_path):
    stream = {"codec_type": "video", "r_frame_rate": "60000/1001", "duration": "10.5", "width": 1920, "height": 1080, "codec_name": "h264"}
    (tmp_path / "a.json").write_text(json.dumps({"streams": [{"codec_type": "audio"}, stream], "format": {"duration": "11"}}))
    (tmp_path / "b.json").write_text(json.dumps({"streams": [{"codec_type": "video", "r_frame_rate": "25", "nb_frames": "77"}], "format": {"duration": "3.001"}}))
    a, b = files.read_probes(spark, str(tmp_path)).orderBy("file").collect()
    assert (a.width, a.height, a.fps, a.duration_sec, a.total_frames, a.codec, a.pix_fmt) == (1920, 1080, 59.94, 10.5, int(60000 / 1001 * 10.5), "h264", "unknown")
    assert (b.width, b.fps, b.duration_sec, b.total_frames) == (0, 25, 3.0, 77)
    (tmp_path / "c.json").write_text('{"streams": [{"codec_type": "audio"}]}')
    with pytest.raises(Exception, match="no video stream"):
        files.read_probes(spark, f"{tmp_path}/c.json").collect()


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text('step 1: PSNR = 20.5\npsnr 22.25 and {"psnr": 23.5}\nPSNR: 99\nPSNR=1.2.3 psnr: 24.\n')
    (tmp_path / "b.log").write_text("nothing")
    a, b = files.read_training_logs(spark, str(tmp_path)).orderBy("file").collect()
    assert a["values"] == [20.5, 24.0, 22.25, 23.5] and a.final == 23.5
    assert b["values"] == [] and b.final is None


def test_arrays(spark, tmp_path):
    array = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", array)
    rows = files.read_npy(spark, f"{tmp_path}/a.npy").collect()
    assert len(rows) == 24 and all(array[tuple(r["index"])] == r.value for r in rows)
    np.save(tmp_path / "b.npy", np.zeros((0, 3)))
    assert files.read_npy(spark, f"{tmp_path}/b.npy").count() == 0


def test_transforms(spark, tmp_path):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q, [1, 2, 3]
    frames = [{"file_path": "images/frame_0001.jpg", "transform_matrix": m.tolist()}, {"file_path": "x", "fl_x": 7, "cx": 0, "transform_matrix": np.eye(4).tolist()}]
    (tmp_path / "t.json").write_text(json.dumps({"fl_x": 500, "cx": 320, "cy": 240, "w": 640, "h": 480, "frames": frames}))
    a, b = files.read_transforms(spark, f"{tmp_path}/t.json").collect()
    flip = np.diag([1, -1, -1])
    assert a.stem == "frame_0001" and np.allclose(np.array(a.r).reshape(3, 3), flip @ q.T) and np.allclose(a.t, flip @ -q.T @ [1, 2, 3])
    assert (a.fx, a.fy, a.cx, a.width) == (500, 500, 320, 640) and (b.stem, b.fx, b.fy, b.cx) == ("x", 7, 7, 320)
