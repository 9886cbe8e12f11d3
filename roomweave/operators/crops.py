"""Filters of points by boxes, percentiles, depth and their class's centre."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.functions.geometry import distance
from roomweave.operators.ranks import percentiles

AXES = ("x", "y", "z")
#: The room's box.
ROOM = {"x": (-5.0, 5.0), "y": (-5.5, 4.5), "z": (-5.0, 5.5)}


def in_box(points: DataFrame, box: dict[str, tuple[float, float]] = ROOM) -> DataFrame:
    """Points within the box, its sides included."""
    inside = F.lit(True)
    for c, (lo, hi) in box.items():
        inside = inside & F.col(c).between(lo, hi)
    return points.where(inside)


def percentile_crop(points: DataFrame, core: Column, lo: float = 0.02, hi: float = 0.98, more: float = 0.30, least: int = 100) -> DataFrame:
    """Points within the percentiles of the core on each axis and a share of that length beyond; a core of ``least`` or
    fewer points crops nothing. Percentiles are exact."""
    ends = percentiles(points.where(core), {f"_{n}{c}": (c, q) for c in AXES for n, q in (("a", lo), ("b", hi))}, count="_n")
    inside = F.lit(True)
    for c in AXES:
        a, b = F.col(f"_a{c}"), F.col(f"_b{c}")
        inside = inside & F.col(c).between(a - more * (b - a), b + more * (b - a))
    return points.crossJoin(F.broadcast(ends)).where((F.col("_n") <= least) | inside).select(*points.columns)  # one row


def inner_pixels(pixels: DataFrame, height: int, width: int, border: int = 3, stride: int = 2) -> DataFrame:
    """Pixels (v, u) off the border, every so many rows and columns."""
    return pixels.where(F.col("v").between(border, height - border - 1) & F.col("u").between(border, width - border - 1) & (F.col("v") % stride == 0) & (F.col("u") % stride == 0))


def depth_filter(points: DataFrame, frame: str, conf: str, depth: str, least: float = 0.15, times: float = 1.5) -> DataFrame:
    """Points sure enough, no deeper than so many times the 95th percentile of the sure ones of their frame."""
    sure = points.where(F.col(conf) >= least)
    caps = percentiles(sure, {"_cap": (depth, 0.95)}, [frame])
    return sure.join(caps, frame).where(F.col(depth) <= times * F.col("_cap")).select(*points.columns)


def sure_enough(points: DataFrame, conf: str, least: float, share: float = 0.5) -> DataFrame:
    """Points at least so sure; where there is none, those from the given percentile on."""
    found = percentiles(points, {"_p": (conf, share), "_top": (conf, 1.0)})
    floor = found.select(F.when(F.col("_top") >= least, F.lit(float(least))).otherwise(F.col("_p")).alias("_floor"))
    return points.crossJoin(F.broadcast(floor)).where(F.col(conf) >= F.col("_floor")).select(*points.columns)  # one row


def floor_sample(points: DataFrame, opaque: Column, share: float = 0.01, axis: str = "y") -> DataFrame:
    """Opaque points in the lowest share of the axis."""
    held = points.where(opaque)
    return held.crossJoin(F.broadcast(percentiles(held, {"_low": (axis, share)}))).where(F.col(axis) <= F.col("_low")).select(*points.columns)


def class_centroids(points: DataFrame, key: str = "class_idx", least: int = 100) -> DataFrame:
    """(key, x, y, z, n): medians of classes with at least so many points."""
    return percentiles(points, {c: (c, 0.5) for c in AXES}, [key], count="n").where(F.col("n") >= least)


def near_centroid(points: DataFrame, centroids: DataFrame, radii: dict[int, float], usual: float = 1.5, key: str = "class_idx") -> DataFrame:
    """Points closer to their class's centre than its radius; points of a class without a centre stay."""
    radius = F.lit(usual)
    for k, r in radii.items():
        radius = F.when(F.col(key) == k, r).otherwise(radius)
    middles = centroids.select(key, *(F.col(c).alias(f"_{c}") for c in AXES))
    far = distance(tuple(F.col(c) for c in AXES), tuple(F.col(f"_{c}") for c in AXES))
    return points.join(middles, key, "left").where(F.col("_x").isNull() | (far < radius)).select(*points.columns)


def plane_fit(points: DataFrame) -> DataFrame:
    """One row (n, centre, normal, tilt_deg): the plane through points, by the axis along which they spread least, its normal
    turned to negative y; tilt is its angle from there. Covariances are aggregates; fewer than three points give nulls."""
    pairs = [(a, b) for k, a in enumerate(AXES) for b in AXES[k:]]
    sums = points.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in AXES), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))

    def run(frames):
        for f in frames:
            for row in f.itertuples():
                if row.n < 3:
                    yield pd.DataFrame({"n": [row.n], "centre": [None], "normal": [None], "tilt_deg": [None]})
                    continue
                cov = np.array([[getattr(row, "".join(sorted(a + b))) for b in AXES] for a in AXES])
                normal = np.linalg.eigh(cov)[1][:, 0]
                normal = -normal if normal[1] > 0 else normal
                yield pd.DataFrame({"n": [row.n], "centre": [[row.x, row.y, row.z]], "normal": [normal.tolist()], "tilt_deg": [float(np.degrees(np.arccos(np.clip(-normal[1], -1, 1))))]})

    return sums.mapInPandas(run, "n long, centre array<double>, normal array<double>, tilt_deg double")
