"""Batches of camera poses brought into one frame by the frames that neighbouring batches share.

Means and covariances of the shared places are aggregates, so a batch may share any number of frames; only the 3 x 3
decomposition, one for each pair of batches, is done by numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.functions.camera import dot, times
from roomweave.functions.geometry import distance

AXES = ("x", "y", "z")
SIMILARITY = "scale double, r array<double>, t array<double>"


def _solved(cov: np.ndarray, var: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, rotation and translation from new to old of each pair; batches that do not move keep their places."""
    u, s, vt = np.linalg.svd(cov)
    turn = np.sign(np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)))
    mirror = np.repeat(np.eye(3)[None], len(cov), 0)
    mirror[:, 2, 2] = turn
    r = vt.transpose(0, 2, 1) @ mirror @ u.transpose(0, 2, 1)
    still = var < 1e-12
    scale = np.where(still, 1.0, s.sum(1) / np.where(still, 1.0, var))
    r[still] = np.eye(3)
    t = np.where(still[:, None], 0.0, old - scale[:, None] * np.einsum("bij,bj->bi", r, new))
    return scale, r, t


def pair_similarities(shared: DataFrame) -> DataFrame:
    """(track, batch, scale, r, t, n, error) from a batch's own places (nx, ny, nz) to those (px, py, pz) of the batch before.

    ``shared``: (track, batch, px, py, pz, nx, ny, nz), a row a shared frame. error: mean distance of the moved places from
    those of the batch before. A batch whose shared places are one point keeps them as they are.
    """
    sums = [F.count("*").alias("n"), *(F.avg(f"{s}{a}").alias(f"{s}{a}") for s in "pn" for a in AXES), *(F.covar_pop(f"n{a}", f"p{b}").alias(f"c{a}{b}") for a in AXES for b in AXES),
            sum((F.var_pop(f"n{a}") for a in AXES), F.lit(0.0)).alias("var")]
    stats = shared.groupBy("track", "batch").agg(*sums)

    def run(frames):
        for f in frames:
            if len(f):
                cov = f[[f"c{a}{b}" for a in AXES for b in AXES]].to_numpy().reshape(-1, 3, 3)
                scale, r, t = _solved(cov, f["var"].to_numpy(), f[["px", "py", "pz"]].to_numpy(), f[["nx", "ny", "nz"]].to_numpy())
                yield pd.DataFrame({"track": f.track, "batch": f.batch, "scale": scale, "r": list(r.reshape(-1, 9)), "t": list(t), "n": f.n})

    kinds = dict(shared.dtypes)
    found = stats.mapInPandas(run, f"track {kinds['track']}, batch {kinds['batch']}, {SIMILARITY}, n long")
    moved = shared.join(found, ["track", "batch"])
    apart = distance(tuple(_moved([F.col(f"n{a}") for a in AXES])), tuple(F.col(f"p{a}") for a in AXES))
    return found.join(moved.groupBy("track", "batch").agg(F.avg(apart).alias("error")), ["track", "batch"])


def _moved(p: list[Column]) -> list[Column]:
    r = [F.col("r")[i] for i in range(9)]
    return [F.col("scale") * dot(r[3 * i : 3 * i + 3], p) + F.col("t")[i] for i in range(3)]


def registered(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(track, batch, scale, r, t) from each batch's own places to those of its track's first one.

    ``first``: (track, batch) of the batches that keep their places. What a batch needs is the product of all steps before
    it, so the steps of a track, a row of 13 numbers each, meet in one task.
    """
    same = first.select("track", "batch", F.lit(1.0).alias("scale"), F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"))
    steps = same.unionByName(pairs.select("track", "batch", "scale", "r", "t"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("batch")
        scale, r, t, out = 1.0, np.eye(3), np.zeros(3), []
        for s, q, v in zip(f.scale, f.r, f.t):
            q = np.array(q).reshape(3, 3)
            t = scale * r @ np.array(v) + t
            scale, r = scale * s, r @ q
            out.append((scale, r.ravel(), t))
        return pd.DataFrame({"track": f.track, "batch": f.batch, "scale": [o[0] for o in out], "r": [o[1] for o in out], "t": [o[2] for o in out]})

    kinds = dict(steps.dtypes)
    return steps.groupBy("track").applyInPandas(run, f"track {kinds['track']}, batch {kinds['batch']}, {SIMILARITY}")


def aligned_poses(poses: DataFrame, similarities: DataFrame) -> DataFrame:
    """(track, batch, ord, r, t): world-to-camera poses (track, batch, ord, r, t, n_shared) in their track's frame, each frame
    once: the first n_shared of a batch are left to the batch before. r keeps the factor 1 / scale."""
    s = similarities.select("track", "batch", "scale", F.col("r").alias("sr"), F.col("t").alias("st"))
    both = poses.where("ord >= n_shared").join(s, ["track", "batch"])
    e, q = [F.col("r")[i] for i in range(9)], [F.col("sr")[i] for i in range(9)]
    r = [c / F.col("scale") for c in times(e, [q[3 * j + i] for i in range(3) for j in range(3)])]
    t = [F.col("t")[i] - dot(r[3 * i : 3 * i + 3], [F.col("st")[j] for j in range(3)]) for i in range(3)]
    return both.select("track", "batch", "ord", F.array(*r).alias("r"), F.array(*t).alias("t"))
