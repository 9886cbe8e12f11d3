"""Splats: their PLY columns as arrays, and the packed records of 32 bytes that viewers read."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.functions.geometry import SH_C0, sigmoid
from roomweave.sources.ply import read_ply


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, x, y, z, f_dc, opacity, f_rest, scale, rot): f_rest in numeric order; scale and rot are null where the file has none."""
    rows = read_ply(spark, path)
    number = lambda c: int(re.search(r"\d+$", c)[0])

    def group(prefix):
        names = sorted((c for c in rows.columns if re.fullmatch(prefix + r"\d+", c)), key=number)
        return (F.array(*names) if names else F.lit(None).cast("array<float>")).alias(prefix.rstrip("_"))

    return rows.select("file", "row", "x", "y", "z", group("f_dc_"), "opacity", group("f_rest_"), group("scale_"), group("rot_"))


def _byte(x):
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)).cast("int")


def packed_columns(splats: DataFrame, highlight: bool = False, rgb: tuple[float, float, float] | None = None) -> DataFrame:
    """splats with size (radii), rgba and turn (bytes): colours by a sigmoid and alpha by opacity; for a highlight, colours
    cut off at 0 and 1 or one colour for all, and full alpha. Quaternions of length below 1e-8 are not normalised."""
    base = lambda k: F.col("f_dc")[k] * SH_C0 + 0.5
    if highlight:
        colour = [F.lit(int(c * 255)) for c in rgb] if rgb else [_byte(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base(k))) * 255) for k in range(3)]
        alpha = F.lit(255)
    else:
        colour, alpha = [_byte(sigmoid(base(k)) * 255) for k in range(3)], _byte(sigmoid(F.col("opacity").cast("double")) * 255)
    length = F.sqrt(F.aggregate("rot", F.lit(0.0), lambda a, q: a + q.cast("double") * q))
    turn = F.transform("rot", lambda q: _byte((q / F.when(length < 1e-8, 1.0).otherwise(length) + 1) * 0.5 * 255))
    return splats.select("*", F.transform("scale", lambda s: F.exp(s)).alias("size"), F.array(*colour, alpha).alias("rgba"), turn.alias("turn"))


def pack(splats: DataFrame, highlight: bool = False, rgb: tuple[float, float, float] | None = None) -> DataFrame:
    """(part, n_rows, content): records of 32 bytes, a piece a batch, in the order of rows; for a highlight, the most opaque
    first, by ranges of opacity."""
    rows = packed_columns(splats, highlight, rgb)
    if highlight:
        rows = rows.repartitionByRange(F.desc("opacity"), "row").sortWithinPartitions(F.desc("opacity"), "row")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                out = np.zeros((n, 32), np.uint8)
                wide = lambda c, kind, k: np.array(batch.column(c).to_pylist(), kind).reshape(n, k)
                xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).astype("<f4")
                out[:, :12], out[:, 12:24] = xyz.view(np.uint8), wide("size", "<f4", 3).view(np.uint8)
                out[:, 24:28], out[:, 28:] = wide("rgba", np.uint8, 4), wide("turn", np.uint8, 4)
                yield pa.record_batch({"n_rows": pa.array([n], pa.int64()), "content": pa.array([out.tobytes()], pa.binary())})

    made = rows.select("x", "y", "z", "size", "rgba", "turn").mapInArrow(run, "n_rows bigint, content binary")
    return made.select(F.monotonically_increasing_id().alias("part"), "n_rows", "content")


def splat_properties(n_rest: int = 0) -> dict[str, str]:
    """The properties of a splat file in their fixed order, for ply.ply_parts."""
    names = ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{k}" for k in range(3)), *(f"f_rest_{k}" for k in range(n_rest)), "opacity", *(f"scale_{k}" for k in range(3)), *(f"rot_{k}" for k in range(4))]
    return dict.fromkeys(names, "float")


def splat_columns(splats: DataFrame, n_rest: int = 0) -> DataFrame:
    """splats with a column a property; normals are 0."""
    items = [(c, k) for c, n in (("f_dc", 3), ("f_rest", n_rest), ("scale", 3), ("rot", 4)) for k in range(n)]
    return splats.select("x", "y", "z", *(F.lit(0.0).cast("float").alias(c) for c in ("nx", "ny", "nz")), "opacity", *(F.col(c)[k].alias(f"{c}_{k}") for c, k in items))
