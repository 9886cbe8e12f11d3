"""Sizes and orientation of image files from their first bytes, and what follows for intrinsics and boxes."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, name string, kind string, stored_width int, stored_height int, orientation int, width int, height int"


def _exif_orientation(data: bytes) -> int:
    """Tag 0x0112 of an Exif block; 1 where there is none or the block is broken."""
    if not data.startswith(b"Exif\0\0") or len(data) < 14:
        return 1
    order = {b"II": "<", b"MM": ">"}.get(data[6:8])
    if order is None:
        return 1
    try:
        (at,) = struct.unpack_from(order + "I", data, 10)
        (n,) = struct.unpack_from(order + "H", data, 6 + at)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHIH", data, 8 + at + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def image_header(data: bytes) -> tuple[str, int, int, int] | None:
    """(kind, width, height, orientation) of a PNG or JPEG file as stored; None for any other, or one cut short."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            width, height = struct.unpack_from(">II", data, 16)
            at, orientation = 8, 1
            while at + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"eXIf":
                    orientation = _exif_orientation(b"Exif\0\0" + data[at + 8 : at + 8 + size])
                if kind in (b"eXIf", b"IDAT"):
                    break
                at += 12 + size
            return "png", width, height, orientation
        if data.startswith(b"\xff\xd8"):
            at, orientation = 2, 1
            while True:
                while data[at] == 0xFF and data[at + 1] == 0xFF:  # filling
                    at += 1
                marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if data[at] != 0xFF:
                    return None
                if marker == 0xE1:
                    found = _exif_orientation(data[at + 4 : at + 2 + size])
                    orientation = found if found != 1 else orientation
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # start of frame
                    height, width = struct.unpack_from(">HH", data, at + 5)
                    return "jpeg", width, height, orientation
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, kind, stored_width, stored_height, orientation, width, height) of PNG and JPEG files.

    width and height are as shown: orientations 5 to 8 lie on their side.  Of files that are neither, all but file and name
    are null; empty files are not listed.  Pixels are not decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        for batch in batches:
            rows = []
            for file, name, content in zip(batch.column("file").to_pylist(), batch.column("name").to_pylist(), batch.column("content")):
                kind, w, h, turn = image_header(content.as_buffer().to_pybytes()) or (None,) * 4
                rows.append((file, name, kind, w, h, turn, *((h, w) if (turn or 1) >= 5 else (w, h))))
            types = [pa.string()] * 3 + [pa.int32()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA)


def rescaled(cameras: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cameras (width, height, fx, fy, cx, cy, name of an image) for the size that the image has; those without a file stay as they are.

    Each axis has its own factor; the new size is that of the file.
    """
    size = sizes.select("name", F.col("width").alias("_w"), F.col("height").alias("_h")).where("_w IS NOT NULL").dropDuplicates(["name"])
    x, y = (F.coalesce(F.col(f"_{a[0]}") / F.nullif(F.col(a), F.lit(0)), F.lit(1.0)) for a in ("width", "height"))
    return cameras.join(size, "name", "left").withColumns({"fx": F.col("fx") * x, "cx": F.col("cx") * x, "fy": F.col("fy") * y, "cy": F.col("cy") * y, "width": F.coalesce("_w", "width"), "height": F.coalesce("_h", "height")}).select(*cameras.columns)


def rescaled_box(box: Column, from_width: Column, from_height: Column, to_width: Column, to_height: Column) -> Column:
    """A box (x, y, w, h) of an image of one size, in an image of another."""
    x, y = to_width / from_width, to_height / from_height
    return F.array(*(box[k] * (y if k % 2 else x) for k in range(4)))
