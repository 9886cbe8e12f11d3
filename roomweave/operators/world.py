"""Normal position of a reconstruction: up, centre and scale from its cameras, then axes from its points.

Means, sums, moments and one median are aggregates over all rows; only a row of them comes to the driver, where matrices of
three rows are turned.  Points and cameras then move by one expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.operators.ranks import percentiles

AXES = ("x", "y", "z")


def moved(rows: DataFrame, transform: np.ndarray, columns: tuple[str, str, str] = AXES) -> DataFrame:
    """The three columns as places, by a matrix of 4 rows."""
    t = transform.tolist()
    return rows.withColumns({c: t[k][0] * F.col(columns[0]) + t[k][1] * F.col(columns[1]) + t[k][2] * F.col(columns[2]) + t[k][3] for k, c in enumerate(columns)})


def moved_cameras(cameras: DataFrame, transform: np.ndarray) -> DataFrame:
    """Cameras (x, y, z, r: array of 9, rows, from the camera to the world): places move, rotations turn and keep length 1."""
    scale = np.cbrt(np.linalg.det(transform[:3, :3]))
    t = (transform[:3, :3] / scale).tolist()
    r = F.array(*(sum((t[i][k] * F.col("r")[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)))
    return moved(cameras.withColumn("r", r), transform)


def from_cameras(cameras: DataFrame) -> np.ndarray:
    """The similarity that turns the cameras' mean up to -y, moves what they look at to the origin and brings their median distance to 1.

    What they look at is the place closest to all their axes, and closest to their mean where the axes leave a choice.
    Of cameras with no mean up, or all in that place, only what can be told is changed.
    """
    up = cameras.agg(*(F.avg(-F.col("r")[3 * k + 1]).alias(c) for k, c in enumerate(AXES))).first()  # one row
    transform = np.eye(4)
    if up.x is None:
        return transform
    v = np.array(tuple(up))
    if np.linalg.norm(v) > 1e-9:
        v, target = v / np.linalg.norm(v), np.array([0.0, -1.0, 0.0])
        cross, dot = np.cross(v, target), float(v @ target)
        skew = np.array([[0, -cross[2], cross[1]], [cross[2], 0, -cross[0]], [-cross[1], cross[0], 0]])
        transform[:3, :3] = np.eye(3) + skew + skew @ skew / (1 + dot) if dot > -1 + 1e-12 else np.diag([-1.0, -1.0, 1.0])
    turned = moved_cameras(cameras, transform)
    mean = np.array(tuple(turned.agg(*(F.avg(c) for c in AXES)).first()))  # one row
    ahead, off = [F.col("r")[3 * k + 2] for k in range(3)], [F.col(c) - m for c, m in zip(AXES, mean.tolist())]
    across = {(i, j): (1.0 if i == j else 0.0) - ahead[i] * ahead[j] for i in range(3) for j in range(3)}
    sums = turned.agg(*(F.sum(across[i, j]).alias(f"a{i}{j}") for i, j in across), *(F.sum(sum((across[i, j] * off[j] for j in range(3)), F.lit(0.0))).alias(f"b{i}") for i in range(3))).first()  # one row
    a, b = np.array([[sums[f"a{i}{j}"] for j in range(3)] for i in range(3)]), np.array([sums[f"b{i}"] for i in range(3)])
    transform[:3, 3] -= mean + np.linalg.pinv(a, rcond=1e-9) @ b
    distance = F.sqrt(sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0)))
    far = percentiles(moved(cameras, transform).select(distance.alias("d")), {"far": ("d", 0.5)}).first().far  # one row
    if far > 1e-12:
        transform[:3] /= far
    return transform


def from_points(points: DataFrame, least: int = 11) -> np.ndarray:
    """The turn that brings the directions in which points spread most to x, then y, about their mean; none for fewer than ``least``.

    An axis points to where the cubes of distances along it sum to more than 0, so that the same points in another
    position end up in the same place; the last is the cross product of the others.
    """
    pairs = [(a, b) for k, a in enumerate(AXES) for b in AXES[k:]]
    found = points.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in AXES), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs)).first()  # one row
    if found.n < least:
        return np.eye(4)
    middle = np.array([found[c] for c in AXES])
    spread = np.array([[found["".join(sorted(a + b))] for b in AXES] for a in AXES])
    axes = np.linalg.eigh(spread)[1][:, ::-1].T
    d = [F.col(c) - m for c, m in zip(AXES, middle.tolist())]
    on = [sum((float(a[k]) * d[k] for k in range(3)), F.lit(0.0)) for a in axes]
    cubes = points.agg(*(F.sum(x * x * x).alias(f"c{k}") for k, x in enumerate(on[:2]))).first()  # one row
    axes[:2] *= np.where(np.array(tuple(cubes)) < 0, -1.0, 1.0)[:, None]
    axes[2] = np.cross(axes[0], axes[1])
    transform = np.eye(4)
    transform[:3, :3], transform[:3, 3] = axes, -axes @ middle
    return transform


def normalised(cameras: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Cameras and points in normal position, and the transform that brought them there."""
    first = from_cameras(cameras)
    second = from_points(moved(points, first))
    transform = second @ first
    return moved_cameras(cameras, transform), moved(points, transform), transform
