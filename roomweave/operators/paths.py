"""Camera paths: keyframes picked evenly, steps between them, and circles around a scene."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.functions.camera import centre, dot, look_at, unit
from roomweave.functions.geometry import lerp, slerp


def keyframes(rows: DataFrame, n: int, k: int, number: str = "rn") -> DataFrame:
    """Of n rows numbered from 0, the k (2 at least) at even steps from first to last, rounded half to even; a row picked twice is one."""
    wanted = rows.sparkSession.range(k).select(F.rint(F.col("id") * (n - 1) / (k - 1)).cast("long").alias(number)).distinct()
    return rows.join(F.broadcast(wanted), number)  # k rows


def segments(keys: DataFrame, order: str, values: list[str], n_keys: int, n_frames: int, turn: list[str] = ()) -> DataFrame:
    """(order, step, values): from each key to the next, so many steps that all segments have about n_frames together.

    Keys are of one path, picked by keyframes(), and few; they meet in one task, as their order demands.
    """
    steps = max(1, round(n_frames / max(1, n_keys - 1)))
    w = W.orderBy(order)
    ahead = keys.select(order, *values, *turn, *(F.lead(c).over(w).alias(f"_{c}") for c in [order, *values, *turn])).where(F.col(f"_{order}").isNotNull())
    made = ahead.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    t = F.col("step") / F.lit(float(steps))
    turned = slerp([F.col(c) for c in turn], [F.col(f"_{c}") for c in turn], t) if turn else []
    return made.select(order, "step", *(lerp(F.col(c), F.col(f"_{c}"), t).alias(c) for c in values), *(q.alias(c) for q, c in zip(turned, turn)))


def orbit(spark: SparkSession, middle: tuple[float, float, float], radius: float, n: int, arc: float = 360.0, rise: float = 0.0, up: tuple[float, float, float] = (0.0, -1.0, 0.0)) -> DataFrame:
    """(frame, r, t): cameras on an arc around the middle in the floor plane, ``rise`` above it, looking at it. A full
    circle does not repeat its first camera."""
    angle = F.col("id") * math.radians(arc) / (n if arc % 360 == 0 else max(1, n - 1))
    m = [F.lit(c) for c in middle]
    eye = [m[0] + radius * F.cos(angle), m[1] + rise * (-1 if up[1] < 0 else 1), m[2] + radius * F.sin(angle)]
    r, t = look_at(eye, m, [F.lit(c) for c in up])
    return spark.range(n).select(F.col("id").cast("int").alias("frame"), F.array(*r).alias("r"), F.array(*t).alias("t"))


def normalisation(cameras: DataFrame) -> DataFrame:
    """One row (r, centre, scale) from world-to-camera poses (r, t): scale * r * (p - centre) has the mean up of the cameras along y,
    their mean place at the origin, and no coordinate of a camera beyond 1. Two passes of aggregates over the cameras."""
    r, t = [F.col("r")[i] for i in range(9)], [F.col("t")[i] for i in range(3)]
    held = cameras.select(*(c.alias(f"c{k}") for k, c in enumerate(centre(r, t))), *((-r[3 + k]).alias(f"u{k}") for k in range(3)))
    mean = held.agg(*(F.avg(f"{n}{k}").alias(f"m{n}{k}") for n in "cu" for k in range(3)))
    mean = mean.select(F.array(*unit([F.col(f"mu{k}") for k in range(3)])).alias("up"), F.array(*(F.col(f"mc{k}") for k in range(3))).alias("centre"))
    x, y, z = (F.col("up")[k] for k in range(3))
    turn = [1 - x * x / (1 + y), -x, -x * z / (1 + y), x, y, z, -x * z / (1 + y), -z, 1 - z * z / (1 + y)]  # the shortest from up to y
    over = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)))  # up is down: half around x
    mean = mean.select(F.when(y > -1 + 1e-9, F.array(*turn)).otherwise(over).alias("r"), "centre")
    apart = [F.col(f"c{k}") - F.col("centre")[k] for k in range(3)]
    far = F.greatest(*(F.abs(dot([F.col("r")[3 * i + j] for j in range(3)], apart)) for i in range(3)))
    both = held.crossJoin(F.broadcast(mean))  # one row
    return both.groupBy("r", "centre").agg(F.try_divide(F.lit(1.0), F.max(far)).alias("scale"))
