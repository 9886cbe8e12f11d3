"""Sparse reconstructions as files of one piece: cameras.bin, images.bin, points3D.bin."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.operators.frames import numbered
from roomweave.sinks import onefile
from roomweave.sources.colmap import MODELS, PACKS


def _bytes(kind: str) -> Column:
    """How many bytes a row's record takes."""
    if kind == "cameras":
        params = F.lit(None)
        for name, count in MODELS.values():
            params = F.when(F.col("model") == name, count).otherwise(params)
        return 24 + 8 * params.cast("long")
    if kind == "images":
        return 73 + F.octet_length("name") + 24 * F.greatest(F.size("points"), F.lit(0)).cast("long")
    return 51 + 8 * F.greatest(F.size("track"), F.lit(0)).cast("long")


def write_table(rows: DataFrame, path: str, kind: str) -> int:
    """One of cameras, images and points3D in the order of rows; columns as the readers give them. A null list is empty."""
    pack = PACKS[kind]

    def encode(batch: pa.RecordBatch) -> bytes:
        return b"".join(map(pack, batch.to_pylist()))

    return onefile.write(rows, path, lambda n: struct.pack("<Q", n), _bytes(kind), encode)


def write_reconstruction(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> dict[str, int]:
    """The three files in the folder, each in order of ids."""
    return {kind: write_table(rows.orderBy(key), f"{folder}/{kind}.bin", kind)
            for kind, rows, key in (("cameras", cameras, "camera_id"), ("images", images, "image_id"), ("points3D", points, "point3d_id"))}


def confident_points(points: DataFrame, least: float = 3.0, most: int = 100_000, key: str = "pid") -> DataFrame:
    """(point3d_id, x .. blue, error, track) of points (pid, x .. blue, conf) that are sure enough, numbered from 1.

    Of more than ``most``, those of the least hashes of their key: a sample that is the same on every run.
    """
    sure = points.where(F.col("conf") >= least).withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(most)
    return numbered(sure.drop("_h"), [key], "_place").select((F.col("_place") + 1).cast("long").alias("point3d_id"), "x", "y", "z", "red", "green", "blue", F.lit(0.0).alias("error"),
                                                      F.array().cast("array<struct<image_id:int,point2d_idx:int>>").alias("track"))
