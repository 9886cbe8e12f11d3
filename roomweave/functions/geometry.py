"""Column expressions for geometry, colour and splat attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SH_C0 = 0.28209479177387814  # fixed value: zeroth spherical-harmonics basis


def generated(**columns: Column) -> Column:
    """One row a row with a struct of the columns, each computed once.

    Spark writes a plain column's expression out wherever later ones use it; long ones then grow past what is compiled.
    """
    return F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def sigmoid(x: Column, most: float | None = None) -> Column:
    """most: x is cut to plus or minus this first."""
    x = x if most is None else F.least(F.lit(most), F.greatest(F.lit(-most), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sh_to_byte(f_dc: Column) -> Column:
    """Zeroth-order colour coefficient to 0..255, cut off below the point."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), (f_dc * SH_C0 + 0.5) * 255.0)).cast("int")


def byte_to_sh(c: Column) -> Column:
    return (c / 255.0 - 0.5) / SH_C0


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def cell(x: Column, origin: Column | float, size: float) -> Column:
    """Index of a grid cell, cut toward zero."""
    return ((x - origin) / size).cast("int")


def bucket(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def pixel(axis: Column, depth: Column, focal: float, centre: float) -> Column:
    """Pixel of a point in front of a pinhole camera (half to even); null behind it."""
    return F.rint(F.when(depth > 0, axis / depth) * focal + centre).cast("int")


def provenance(conf: Column) -> Column:
    return F.when(conf > 0.7, "observed").when(conf >= 0.3, "sparse").otherwise("inferred")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major rotation matrix of a quaternion, which is normalised first; of the zero quaternion: null."""
    n = F.nullif(F.sqrt(w * w + x * x + y * y + z * z), F.lit(0.0))
    w, x, y, z = w / n, x / n, y / n, z / n
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Unit quaternions between a and b along the shorter arc; nearly equal ones linearly, then normalised."""
    dot = sum((p * q for p, q in zip(a, b)), F.lit(0.0))
    sign, size = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(size)
    close = size > 0.9995
    wa = F.when(close, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    wb = sign * F.when(close, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle)))
    out = [wa * p + wb * q for p, q in zip(a, b)]
    norm = F.sqrt(sum((c * c for c in out), F.lit(0.0)))
    return [F.try_divide(c, norm) for c in out]
