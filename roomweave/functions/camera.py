"""Column expressions for camera poses, splat attributes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomweave.functions.geometry import byte_to_sh

Vector = list[Column]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: Vector, b: Vector) -> Column:
    return sum((p * q for p, q in zip(a, b)), F.lit(0.0))


def unit(a: Vector) -> Vector:
    """Null for the zero vector."""
    n = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return [c / n for c in a]


def times(a: Vector, b: Vector) -> Vector:
    """The product of two 3 x 3 matrices, row by row."""
    return [dot(a[3 * i : 3 * i + 3], b[j::3]) for i in range(3) for j in range(3)]


def matrix_quaternion(r: Vector) -> Vector:
    """(w, x, y, z) of a rotation matrix, by the largest of its four squares."""
    trace = r[0] + r[4] + r[8]
    size = {"w": 1 + trace, "x": 1 + r[0] - r[4] - r[8], "y": 1 - r[0] + r[4] - r[8], "z": 1 - r[0] - r[4] + r[8]}
    wx, wy, wz, xy, xz, yz = r[7] - r[5], r[2] - r[6], r[3] - r[1], r[1] + r[3], r[2] + r[6], r[5] + r[7]
    best = F.when(trace > 0, "w").when((r[0] > r[4]) & (r[0] > r[8]), "x").when(r[4] > r[8], "y").otherwise("z")
    cases = {"w": (size["w"], wx, wy, wz), "x": (wx, size["x"], xy, xz), "y": (wy, xy, size["y"], yz), "z": (wz, xz, yz, size["z"])}
    chosen = lambda k: F.coalesce(*(F.when(best == c, v[k] / (2 * F.sqrt(size[c]))) for c, v in cases.items()))
    return [chosen(k) for k in range(4)]


def rotation_between(a: Vector, b: Vector) -> Vector:
    """The matrix that turns the direction of a into that of b; opposite ones turn half around an axis across a."""
    a, b = unit(a), unit(b)
    axis, c = cross(a, b), dot(a, b)
    zero = F.lit(0.0)
    k = [zero, -axis[2], axis[1], axis[2], zero, -axis[0], -axis[1], axis[0], zero]
    square = times(k, k)
    across = unit([F.when(F.abs(a[0]) < 0.9, p).otherwise(q) for p, q in zip(cross(a, [F.lit(1.0), zero, zero]), cross(a, [zero, F.lit(1.0), zero]))])
    one = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    half = [2 * across[i // 3] * across[i % 3] - one[i] for i in range(9)]
    return [F.when(c < -1 + 1e-9, half[i]).otherwise(one[i] + k[i] + F.try_divide(square[i], 1 + c)) for i in range(9)]


def look_at(eye: Vector, target: Vector, up: Vector) -> tuple[Vector, Vector]:
    """The rotation (rows right, down, forward) and translation from the world to a camera at eye."""
    forward = unit([t - e for t, e in zip(target, eye)])
    right = unit(cross(forward, up))
    r = [*right, *cross(forward, right), *forward]
    return r, [-dot(r[3 * i : 3 * i + 3], eye) for i in range(3)]


def centre(r: Vector, t: Vector) -> Vector:
    """Where the camera of a world-to-camera pose stands."""
    return [-dot(r[i::3], t) for i in range(3)]


def turn_about(v: Vector, axis: Vector, angle: Column) -> Vector:
    """v turned about a unit axis."""
    c, s, along = F.cos(angle), F.sin(angle), dot(axis, v)
    return [p * c + q * s + a * along * (1 - c) for p, q, a in zip(v, cross(axis, v), axis)]


def scaled_intrinsics(fx: Column, fy: Column, width: Column, height: Column, resolution: int) -> Vector:
    """fx, fy, cx, cy at the image's size, of intrinsics for a square of ``resolution``; the middle is the principal point."""
    s = F.greatest(width, height) / resolution
    return [fx * s, fy * s, width / 2, height / 2]


def hex_bytes(colour: Column) -> Vector:
    """The bytes of #rrggbb."""
    digits = F.ltrim(colour, F.lit("#"))
    return [F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int") for k in range(3)]


def tinted(f_dc: Vector, colour: Vector, labelled: Column, share: float = 0.18) -> Vector:
    """Labelled splats take a share of their class colour (bytes)."""
    return [F.when(labelled, (1 - share) * f + share * byte_to_sh(c)).otherwise(f) for f, c in zip(f_dc, colour)]


def dimmed(byte: Column, labelled: Column, share: float = 0.30) -> Column:
    """Colours of points without a label, cut off below the point."""
    return F.when(labelled, byte).otherwise((byte * share).cast("int"))


def quaternion_bytes(q: Vector) -> Vector:
    length = F.sqrt(dot(q, q))
    return [F.least(F.lit(255.0), F.greatest(F.lit(0.0), (c / F.when(length < 1e-8, 1.0).otherwise(length) + 1) * 0.5 * 255)).cast("int") for c in q]


def clamped_pixel(u: Column, size: Column, border: int = 50) -> Column:
    """A pixel at least so far from the border; the middle of the image where there is none."""
    return F.when(u.isNotNull(), F.least(size - border, F.greatest(F.lit(border), u))).otherwise(F.floor(size / 2).cast("int"))


def seen_at(p: Vector, r: Vector, t: Vector, fx: Column, fy: Column, cx: Column, cy: Column) -> Vector:
    """(u, v, depth) of a place in the world before a camera, not rounded; u and v are null at depth 0."""
    x, y, z = (dot(r[3 * i : 3 * i + 3], p) + t[i] for i in range(3))
    return [F.try_divide(x, z) * fx + cx, F.try_divide(y, z) * fy + cy, z]


def unprojected(u: Column, v: Column, depth: Column, r: Vector, t: Vector, fx: Column, fy: Column, cx: Column, cy: Column) -> Vector:
    """The place in the world of a pixel at a depth: the inverse of seen_at."""
    p = [(u - cx) / fx * depth - t[0], (v - cy) / fy * depth - t[1], depth - t[2]]
    return [dot(r[i::3], p) for i in range(3)]
