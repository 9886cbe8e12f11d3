"""Files of one piece by many tasks, read back in ranges: round trips, headers kept, failed tasks, cut files."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomweave.sinks import colmap as colmap_sink
from roomweave.sinks import documents, npy, onefile
from roomweave.sinks import ply as ply_sink
from roomweave.sinks import splat as splat_sink
from roomweave.sources import colmap, files, ply, splat


def points(spark, n, parts):
    k = F.col("id")
    return spark.range(0, n, 1, parts).select(k.alias("pid"), *((k * s).cast("float").alias(c) for c, s in zip("xyz", (0.5, 1.0, -2.0))), *((k % m).cast("int").alias(c) for c, m in (("red", 7), ("green", 256), ("blue", 3))))


def test_points(spark, tmp_path):
    """One file, several tasks at either end, the order of rows kept."""
    path = str(tmp_path / "deep" / "cloud.ply")
    assert ply_sink.write_ply(points(spark, 5_000, 7), path) == 5_000
    assert os.listdir(tmp_path / "deep") == ["cloud.ply"] and os.path.getsize(path) == len(open(path, "rb").read().split(b"end_header\n")[0]) + 11 + 5_000 * 15
    back = ply.read_ply(spark, path, split=1_000)
    assert back.select(F.spark_partition_id()).distinct().count() > 2
    assert [tuple(r) for r in back.orderBy("row").select("row", "x", "y", "z", "red", "green", "blue").collect()] == [(k, k * 0.5, k, -2.0 * k, k % 7, k % 256, k % 3) for k in range(5_000)]
    ply_sink.write_ply(points(spark, 0, 2), path)
    assert ply.read_ply(spark, path).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        ply.coloured(ply.read_ply(spark, path), least=1)
    with pytest.raises(ValueError, match="colours"):
        ply.coloured(ply.read_ply(spark, path).drop("red"), None)
    assert ply_sink.write_ply(points(spark, 9, 2), f"file://{path}") == 9


def test_header_kept(spark, tmp_path):
    """Comments, the order of properties and that of bytes stay; only the number of rows changes."""
    old, new, tagged = (str(tmp_path / f"{n}.ply") for n in ("old", "new", "tagged"))
    head = "ply\nformat binary_big_endian 1.0\ncomment by hand: element vertex 9\nelement vertex 4\nproperty uchar tag\nproperty double x\nproperty ushort many\nend_header\n"
    rows = np.array([(k, k / 3, 60_000 + k) for k in range(4)], dtype=[("tag", ">u1"), ("x", ">f8"), ("many", ">u2")])
    (tmp_path / "old.ply").write_bytes(head.encode() + rows.tobytes())
    read = ply.read_ply(spark, old)
    assert ply_sink.rewrite_ply(read.where("row <> 1").orderBy("row"), old, new) == 3
    assert (tmp_path / "new.ply").read_bytes() == head.replace("vertex 4", "vertex 3").encode() + rows[[0, 2, 3]].tobytes()
    ply_sink.write_tagged(read.orderBy("row").withColumn("confidence_tag", (F.col("row") % 3).cast("int")), tagged, {"x": "double", "many": "ushort"})
    assert [tuple(r) for r in ply.read_ply(spark, tagged).orderBy("row").select("x", "many", "confidence_tag").collect()] == [(k / 3, 60_000 + k, k % 3) for k in range(4)]
    (tmp_path / "odd.ply").write_bytes(head.replace("ushort", "quad").encode() + rows.tobytes())
    with pytest.raises(KeyError):
        ply.read_ply(spark, str(tmp_path / "odd.ply"))
    with pytest.raises(ValueError):
        ply_sink.rewrite_ply(read, str(tmp_path / "text.ply") if (tmp_path / "text.ply").write_text(head.replace("binary_big_endian", "ascii")) else "", new)


def test_failed_task(spark, tmp_path):
    """Where a task fails, an older file stays as it was and nothing else is left."""
    path = str(tmp_path / "a.ply")
    ply_sink.write_ply(points(spark, 10, 2), path)
    before = (tmp_path / "a.ply").read_bytes()
    broken = points(spark, 1_000, 4)

    def fail(batch):
        if 700 in batch.column("pid").to_pylist():
            raise RuntimeError("broken")
        return b"." * batch.num_rows

    for encode in (fail, lambda batch: b".." * batch.num_rows, lambda batch: b""):
        with pytest.raises(Exception):
            onefile.write(broken, path, lambda n: b"", F.lit(1), encode)
    assert os.listdir(tmp_path) == ["a.ply"] and (tmp_path / "a.ply").read_bytes() == before
    with pytest.raises(ValueError, match="shared folder"):
        onefile.write(broken, "s3://bucket/a", lambda n: b"", F.lit(1), fail)


def test_splats(spark, tmp_path):
    rows = [(k, float(k), 0.0, 1.0, [0.1, -9.0, 9.0], float(k % 50) - 20, [float(x + k) for x in range(12)], [0.0, 1.0, -1.0], [2.0, 0.0, 0.0, 0.0]) for k in range(400)]
    made = spark.createDataFrame(rows, "row long, x float, y float, z float, f_dc array<float>, opacity float, f_rest array<float>, scale array<float>, rot array<float>").repartitionByRange(5, "row")
    ply_sink.write_splats(made, str(tmp_path / "a.ply"), 12)
    back = splat.read_splats(spark, str(tmp_path / "a.ply")).orderBy("row").collect()
    assert [(r.row, r.x, r.f_rest, r.opacity) for r in back] == [(r[0], r[1], r[6], r[5]) for r in rows]
    for bright in (False, True):
        assert splat_sink.write_packed(made, str(tmp_path / "a.splat"), bright) == 400
        data = (tmp_path / "a.splat").read_bytes()
        order = sorted(rows, key=lambda r: (-r[5], r[0])) if bright else rows
        assert len(data) == 32 * 400 and [struct.unpack_from("<f", data, 32 * k)[0] for k in range(400)] == [r[1] for r in order]


def test_reconstruction(spark, tmp_path):
    """Records of many lengths, in ranges of a few hundred bytes; files cut short are errors."""
    cameras = [(k + 1, *(("PINHOLE", 640, 480, [5.0, 6.0, 7.0, 8.0]) if k % 2 else ("SIMPLE_RADIAL", 10, 20, [5.0, 1.0, 2.0, 0.1]))) for k in range(9)]
    images = [(k, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "é" * (k % 5) + f"{k}.jpg", [(float(i), 2.5, i - 1) for i in range(k % 13)]) for k in range(60)]
    found = [(k, 1.0 * k, 2.0, 3.0, 255, 0, 9, 0.5, [(i, k) for i in range(k % 7)]) for k in range(90)]
    made = [spark.createDataFrame(rows, schema).repartition(4) for rows, schema in ((cameras, colmap.CAMERA), (images, colmap.IMAGE), (found, colmap.POINT))]
    assert colmap_sink.write_reconstruction(*made, str(tmp_path)) == {"cameras": 9, "images": 60, "points3D": 90}
    plain = lambda df, key, k: [(*tuple(r)[1:k], [tuple(x) if isinstance(x, tuple) else x for x in r[k]]) for r in df.orderBy(key).collect()]
    for split in (300, 1 << 20):
        read = [f(spark, str(tmp_path / f"{n}.bin"), split=split) for f, n in ((colmap.read_cameras, "cameras"), (colmap.read_images, "images"), (colmap.read_points3d, "points3D"))]
        assert [plain(df, *x) for df, x in zip(read, (("camera_id", 5), ("image_id", 11), ("point3d_id", 9)))] == [cameras, images, found]
    assert colmap.read_images(spark, str(tmp_path / "images.bin"), split=300).select(F.spark_partition_id()).distinct().count() > 2
    whole = (tmp_path / "points3D.bin").read_bytes()
    (tmp_path / "cut.bin").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends within"):
        colmap.read_points3d(spark, str(tmp_path / "cut.bin")).count()
    kept = colmap_sink.confident_points(points(spark, 500, 3).withColumn("conf", F.col("pid") / 100.0), most=100).collect()
    assert sorted(r.point3d_id for r in kept) == list(range(1, 101)) and all(r.y >= 300 for r in kept)
    assert colmap_sink.confident_points(points(spark, 500, 3).withColumn("conf", F.lit(1.0))).count() == 0


def test_arrays(spark, tmp_path):
    cells = spark.range(3 * 40 * 50).select((F.col("id") % 3).alias("k"), (F.floor(F.col("id") / 3) % 40).alias("j"), F.floor(F.col("id") / 120).alias("i"), (F.col("id") / 7).alias("v")).where("(i + j) % 3 > 0")
    assert npy.write_npy(cells.repartition(6), str(tmp_path / "a.npy"), (50, 40, 3), ["i", "j", "k"], "v") == cells.count()
    want = np.zeros((50, 40, 3), "<f4")
    for r in cells.collect():
        want[r.i, r.j, r.k] = r.v
    assert (np.load(tmp_path / "a.npy") == want).all()
    back = files.read_npy(spark, str(tmp_path / "a.npy"), split=4_000)
    assert back.select(F.spark_partition_id()).distinct().count() > 2 and {tuple(r["index"]): r.value for r in back.collect()} == {i: float(v) for i, v in np.ndenumerate(want)}
    np.save(tmp_path / "f.npy", np.asfortranarray(want))
    assert {tuple(r["index"]): r.value for r in files.read_npy(spark, str(tmp_path / "f.npy"), split=4_000).collect()} == {i: float(v) for i, v in np.ndenumerate(want)}
    for bad in (cells.unionByName(cells.limit(1)), cells.withColumn("j", F.col("j") + 1)):
        with pytest.raises(Exception):
            npy.write_npy(bad, str(tmp_path / "b.npy"), (50, 40, 3), ["i", "j", "k"], "v")
    assert not (tmp_path / "b.npy").exists()


def test_documents(spark, tmp_path):
    documents.write_document(spark.createDataFrame([('{"a": [1, "é"]}',)], "d string"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": [1, "é"]} and "\n  " in (tmp_path / "d.json").read_text()
    with pytest.raises(ValueError):
        documents.write_document(spark.createDataFrame([("{}",)] * 2, "d string"), str(tmp_path / "e.json"))
    documents.write_csv(spark.createDataFrame([("a,b", 1, None), ('say "x"', None, "é")], "name string, n int, t string").coalesce(1), str(tmp_path / "f.csv"), ["name", "n", "t"])
    assert (tmp_path / "f.csv").read_text() == 'name,n,t\n"a,b",1,\n"say ""x""",,é\n'
