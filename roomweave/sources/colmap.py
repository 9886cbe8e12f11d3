"""Sparse reconstructions: the binary files of cameras, images and points, read and written as DataFrames.

Records of a file follow each other without an index.  One task steps over a file's records, reading no more of each than
its length takes, and notes where ranges of them start; many tasks then decode the ranges.  In a store that only Spark
reaches, a file is decoded by one task.  Either way records leave in pieces of ROWS.  Quaternions are (w, x, y, z) in the usual convention; ``transposed`` turns the rotation around, for
files written with the conjugate.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.sources import ranges

# Fixed values of the format: model numbers, names, and how many parameters each has.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8)}
NUMBERS = {name: (number, count) for number, (name, count) in MODELS.items()}
ROWS = 10_000

CAMERA = "camera_id int, model string, width bigint, height bigint, params array<double>"
IMAGE = "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string, points array<struct<x:double,y:double,point3d_id:bigint>>"
POINT = "point3d_id bigint, x double, y double, z double, red int, green int, blue int, error double, track array<struct<image_id:int,point2d_idx:int>>"


def _camera(data: bytes, at: int):
    number, model, width, height = struct.unpack_from("<iiQQ", data, at)
    name, count = MODELS.get(model, MODELS[1])
    return (number, name, width, height, list(struct.unpack_from(f"<{count}d", data, at + 24))), at + 24 + 8 * count


def _image(data: bytes, at: int):
    number, *pose, camera = struct.unpack_from("<i7di", data, at)
    end = data.index(b"\0", at + 64)
    (n,) = struct.unpack_from("<Q", data, end + 1)
    points = [{"x": x, "y": y, "point3d_id": p} for x, y, p in struct.iter_unpack("<ddq", data[end + 9 : end + 9 + 24 * n])]
    return (number, *pose, camera, data[at + 64 : end].decode(), points), end + 9 + 24 * n


def _point(data: bytes, at: int):
    *head, error, n = struct.unpack_from("<q3d3BdQ", data, at)
    track = [{"image_id": i, "point2d_idx": k} for i, k in struct.iter_unpack("<ii", data[at + 51 : at + 51 + 8 * n])]
    return (*head, error, track), at + 51 + 8 * n


def _camera_size(data: bytes, at: int) -> int | None:
    return 24 + 8 * MODELS.get(struct.unpack_from("<i", data, at + 4)[0], MODELS[1])[1] if len(data) >= at + 8 else None


def _image_size(data: bytes, at: int) -> int | None:
    end = data.find(b"\0", at + 64)
    return end + 9 + 24 * struct.unpack_from("<Q", data, end + 1)[0] - at if end >= 0 and len(data) >= end + 9 else None


def _point_size(data: bytes, at: int) -> int | None:
    return 51 + 8 * struct.unpack_from("<Q", data, at + 43)[0] if len(data) >= at + 51 else None


def _cut(file: str, length: int, size, split: int):
    """Ranges of whole records of about split bytes; size(data, at): a record's bytes, or None where data ends before they are known."""
    (left,) = struct.unpack("<Q", ranges.read_range(file, 0, 8))
    more, data, base = ranges.pieces(file, 8), b"", 8  # data starts at base
    at, start, first = 8, 8, 0
    for k in range(left):
        while at - base > len(data) or (found := size(data, at - base)) is None:
            piece = next(more, None)
            if piece is None:
                raise ValueError(f"{file} ends within record {k} of {left}")
            skip = min(at - base, len(data))
            data, base = data[skip:] + piece, base + skip
        at += found
        if at - start >= split or k == left - 1:
            if at > length:
                raise ValueError(f"{file} ends within record {k} of {left}")
            yield start, at, first, k + 1 - first
            start, first = at, k + 1


def _read(spark: SparkSession, path: str, schema: str, record, size, split: int) -> DataFrame:
    files = ranges.listed(spark, path)
    made = files.select("file").limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in schema.split(", ")))).schema
    names = [f.name for f in made]
    one = files.first()

    def decode(file: str, data: bytes, at: int, left: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        types, rows = [to_arrow_schema(made).field(n).type for n in names], []
        for k in range(left):
            row, at = record(data, at)
            rows.append((file, *row))
            if len(rows) == ROWS or k == left - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []

    def read_ranges(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from decode(r["file"], ranges.read_range(r["file"], r["start"], r["stop"]), 0, r["n"])

    def read_contents(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = content.as_py()
                yield from decode(file, data, 8, struct.unpack_from("<Q", data)[0])

    if one is not None and ranges.reachable(one.file):
        return ranges.ranges(files, lambda file, length: _cut(file, length, size, split), split).mapInArrow(read_ranges, made)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(read_contents, made)


def read_cameras(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    """(file, camera_id, model, width, height, params); a model of unknown number is read as PINHOLE."""
    return _read(spark, path, CAMERA, _camera, _camera_size, split)


def read_images(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    """(file, image_id, qw .. tz, camera_id, name, points); a point3d_id of -1 stands for none."""
    return _read(spark, path, IMAGE, _image, _image_size, split)


def read_points3d(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    return _read(spark, path, POINT, _point, _point_size, split)


def intrinsics() -> list[Column]:
    """fx, fy, cx, cy of the columns model and params: models of one focal length use it twice."""
    one = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    p = lambda k: F.get("params", F.lit(k))
    return [p(0).alias("fx"), F.when(one, p(0)).otherwise(p(1)).alias("fy"), F.when(one, p(1)).otherwise(p(2)).alias("cx"), F.when(one, p(2)).otherwise(p(3)).alias("cy")]


def views(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with the intrinsics of their camera; images without one are left out. Cameras are few to images."""
    return images.join(cameras.select("camera_id", "model", "width", "height", *intrinsics()), "camera_id")


def observations(images: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, u, v, point3d_id, x, y, z): what images saw of known points."""
    seen = images.select("image_id", F.explode("points").alias("o")).where("o.point3d_id <> -1")
    return seen.select("image_id", F.col("o.x").alias("u"), F.col("o.y").alias("v"), "o.point3d_id").join(points.select("point3d_id", "x", "y", "z"), "point3d_id")


def dataset(images: DataFrame, cameras: DataFrame, every: int = 8) -> DataFrame:
    """views() in order of names: index from 0, split (every so many is test, from the first on), cx_w, cy_w, cz_w (the camera's place)."""
    from roomweave.functions.geometry import quaternion_matrix
    from roomweave.operators.frames import numbered

    r = quaternion_matrix(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    t = [F.col(c) for c in ("tx", "ty", "tz")]
    centre = [-(r[k] * t[0] + r[3 + k] * t[1] + r[6 + k] * t[2]) for k in range(3)]
    placed = numbered(views(images, cameras), ["name", "image_id"], "index")
    return placed.withColumns({"split": F.when(F.col("index") % every == 0, "test").otherwise("train")} | {f"{c}_w": x for c, x in zip(("cx", "cy", "cz"), centre)})


def _pack_camera(r) -> bytes:
    number, count = NUMBERS[r["model"]]
    return struct.pack(f"<iiQQ{count}d", r["camera_id"], number, r["width"], r["height"], *r["params"][:count])


def _pack_image(r) -> bytes:
    head = struct.pack("<i7di", r["image_id"], *(r[c] for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")), r["camera_id"])
    points = r["points"] or []
    return head + r["name"].encode() + b"\0" + struct.pack("<Q", len(points)) + b"".join(struct.pack("<ddq", p["x"], p["y"], p["point3d_id"]) for p in points)


def _pack_point(r) -> bytes:
    track = r["track"] or []
    head = struct.pack("<q3d3BdQ", r["point3d_id"], r["x"], r["y"], r["z"], r["red"], r["green"], r["blue"], r["error"], len(track))
    return head + b"".join(struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in track)


PACKS = {"cameras": _pack_camera, "images": _pack_image, "points3D": _pack_point}


def file_parts(rows: DataFrame, kind: str) -> DataFrame:
    """(part, n_rows, content): records of a file in pieces, one a batch; content lacks the count that opens the file.

    file_bytes() joins the pieces of one small reconstruction; of a large one, each piece with its own count is a file.
    """
    pack = PACKS[kind]

    def run(batches):
        for batch in batches:
            made = [pack(r) for r in batch.to_pylist()]
            if made:
                yield pa.record_batch({"n_rows": pa.array([len(made)], pa.int64()), "content": pa.array([b"".join(made)], pa.binary())})

    return rows.mapInArrow(run, "n_rows bigint, content binary").select(F.monotonically_increasing_id().alias("part"), "n_rows", "content")


def file_bytes(parts: DataFrame) -> bytes:
    rows = parts.orderBy("part").collect()  # one file of one scene
    return struct.pack("<Q", sum(r.n_rows for r in rows)) + b"".join(bytes(r.content) for r in rows)
