"""Measures of frames' pixels: sharpness, histograms, and filling of masked parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.operators.masks import decode_mask
from roomweave.storage import set_checkpoint_dir

BINS = 64
BLOCK = 2048  # frames of a block
PLACES = 9  # of correlations that are compared


def laplacian_variance(images: np.ndarray, missing: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each image (images, height, width) the variance of the Laplacian (four neighbours; the edge is mirrored at its pixels),
    and whether any pixel counts: missing ones and those beside them do not."""
    inside = lambda v, n: (n - 1) - np.abs((n - 1) - np.abs(v))
    rows, columns = (np.arange(n) for n in images.shape[1:])
    up, down = (inside(rows + k, len(rows)) for k in (-1, 1))
    left, right = (inside(columns + k, len(columns)) for k in (-1, 1))
    response = (images[:, up] + images[:, down] + images[:, :, left] + images[:, :, right] - 4 * images).reshape(len(images), -1)
    if missing is None:
        return response.var(1), np.ones(len(images), bool)
    counts = ~(missing | missing[:, up] | missing[:, down] | missing[:, :, left] | missing[:, :, right]).reshape(response.shape)
    n = counts.sum(1)
    with np.errstate(invalid="ignore"):
        mean = np.where(counts, response, 0.0).sum(1) / n
        return np.where(counts, (response - mean[:, None]) ** 2, 0.0).sum(1) / n, n > 0


def sharpness(pixels: Column, width: int, height: int) -> Column:
    """Variance of the Laplacian of a grey image, an array row by row; -1 where there is no image of that size, null where
    each pixel is missing or beside a missing one."""
    size = width * height

    @F.arrow_udf("double")
    def measure(rows: pa.Array) -> pa.Array:
        held = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(rows), size), False).to_numpy(zero_copy_only=False))
        out, empty = np.full(len(rows), -1.0), np.zeros(len(rows), bool)
        for s in range(0, len(held), step := max(1, 1_000_000 // size)):
            some = held[s : s + step]
            values = rows.take(pa.array(some)).flatten()
            images = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, height, width)
            missing = values.is_null().to_numpy(zero_copy_only=False).reshape(images.shape) if values.null_count else None
            out[some], counted = laplacian_variance(images, missing)
            empty[some] = ~counted
        return pa.array(out, mask=empty)

    return measure(pixels)


def histograms(values: DataFrame) -> DataFrame:
    """(frame, bin, share) of grey values (frame, grey) from 0 to 256, the upper end included; other values do not count."""
    held = values.where(F.col("grey").between(0, 256))
    counts = held.groupBy("frame", F.least(F.floor(F.col("grey") / (256 // BINS)), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("frame").agg(F.sum("n").alias("total")), "frame").select("frame", "bin", (F.col("n") / F.col("total")).alias("share"))


def from_mean(shares: DataFrame) -> DataFrame:
    """(frame, dist): how far each frame's histogram is from the mean of all, bins without pixels included."""
    set_checkpoint_dir(shares.sparkSession)
    shares = shares.checkpoint()  # read three times
    frames = shares.agg(F.countDistinct("frame").alias("frames"))
    mean = shares.groupBy("bin").agg(F.sum("share").alias("sum")).crossJoin(F.broadcast(frames)).select("bin", (F.col("sum") / F.col("frames")).alias("mean"))
    square = mean.agg(F.sum(F.col("mean") * F.col("mean")).alias("square"))
    part = F.sum(F.col("share") * F.col("share") - 2 * F.col("share") * F.col("mean"))
    near = shares.join(F.broadcast(mean), "bin").groupBy("frame").agg(part.alias("part"))  # a row a bin
    return near.crossJoin(F.broadcast(square)).select("frame", F.sqrt(F.greatest(F.lit(0.0), F.col("part") + F.col("square"))).alias("dist"))


def _grown(mask: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def fill_masked(image: np.ndarray, mask: np.ndarray, ring: int = 15, blur: int = 5) -> np.ndarray:
    """The image (height, width, channels of bytes) with masked pixels of the median colour around the mask (128 where nothing is
    around it), then the mean of a square of pixels, mirrored beyond the edge."""
    around = _grown(mask, ring) & ~mask
    out = image.astype(np.float64)
    out[mask] = np.median(out[around], axis=0) if around.any() else 128.0
    padded = np.pad(out, ((blur // 2,) * 2, (blur // 2,) * 2, (0, 0)), mode="symmetric")
    mean = np.lib.stride_tricks.sliding_window_view(padded, (blur, blur), axis=(0, 1)).mean(axis=(-2, -1))
    out[mask] = mean[mask]
    return out.astype(np.uint8)


def inpaint(frames: DataFrame) -> DataFrame:
    """(frame, height, width, pixels): frames (frame, height, width, pixels of bytes r, g, b row by row, counts of the mask) with
    their masks filled. An image is the unit of work."""

    def run(batches):
        for f in batches:
            filled = [fill_masked(np.frombuffer(p, np.uint8).reshape(h, w, 3), decode_mask(c, h, w)).tobytes() for h, w, p, c in zip(f.height, f.width, f.pixels, f.counts)]
            yield pd.DataFrame({"frame": f.frame, "height": f.height, "width": f.width, "pixels": filled})

    return frames.select("frame", "height", "width", "pixels", "counts").mapInPandas(run, f"frame {dict(frames.dtypes)['frame']}, height int, width int, pixels binary")


def most_alike(shares: DataFrame, k: int) -> DataFrame:
    """(frame, rank from 1, other, correlation): for each frame the k others whose histograms (frame, bin, share) go with its own most.

    Correlations over all bins, empty ones included, are rounded to PLACES before they are compared; of equals the smaller
    frame comes first.  Frames of one share in every bin have none and take no part.

    Frames are dealt into blocks by a hash; each block meets each block once, as a product of two matrices of BLOCK rows,
    of which only the k best a frame are sent on.  So the matrix of all frames is never there.
    """
    set_checkpoint_dir(shares.sparkSession)
    n = max(1, -(-shares.select("frame").distinct().count() // BLOCK))
    vectors = shares.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"))  # BINS entries at most
    dense = vectors.select("frame", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("v"), F.pmod(F.xxhash64("frame"), F.lit(n)).cast("int").alias("block"))

    def gather(table: pa.Table) -> pa.Table:
        v = np.array(table["v"].to_pylist(), float).reshape(-1, BINS)
        v -= v.mean(1, keepdims=True)
        norm = np.sqrt((v * v).sum(1))
        held = norm > 1e-9
        ids = table["frame"].to_numpy()[held].astype("<i8")
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "unit": [(v[held] / norm[held, None]).tobytes()]})

    blocks = dense.groupBy("block").applyInArrow(gather, "block int, ids binary, unit binary").checkpoint()

    def tiles(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a_ids, b_ids = (np.frombuffer(r[c], "<i8") for c in ("a_ids", "b_ids"))
                a, b = (np.frombuffer(r[c]).reshape(-1, BINS) for c in ("a_unit", "b_unit"))
                order = np.argsort(b_ids)
                b_ids, b = b_ids[order], b[order]
                score = np.round(a @ b.T, PLACES)
                score[a_ids[:, None] == b_ids[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # of equals the smaller frame, as columns ascend
                found = np.take_along_axis(score, best, 1)
                held = np.isfinite(found)
                yield pa.record_batch([pa.array(np.repeat(a_ids, best.shape[1]).reshape(best.shape)[held]), pa.array(b_ids[best[held]]), pa.array(found[held])], names=["frame", "other", "correlation"])

    named = lambda p: blocks.select(*(F.col(c).alias(f"{p}_{c}") for c in ("block", "ids", "unit")))
    # A row for each pair of blocks, with their numbers only; the blocks themselves follow by joins.
    each = shares.sparkSession.range(n * n).select((F.col("id") % n).cast("int").alias("a_block"), F.floor(F.col("id") / n).cast("int").alias("b_block"))
    met = each.join(named("a"), "a_block").join(named("b"), "b_block").repartition(min(10_000, n * n), "a_block", "b_block")
    found = met.mapInArrow(tiles, "frame long, other long, correlation double")
    first = W.partitionBy("frame").orderBy(F.desc("correlation"), "other")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("frame", "rank", "other", "correlation")
