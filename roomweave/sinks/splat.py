"""Packed splats as one file, in the order of rows or, for a highlight, with the most opaque first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.sinks import onefile
from roomweave.sources.splat import packed_columns

RECORD = 32


def _records(batch: pa.RecordBatch) -> bytes:
    n = batch.num_rows
    out = np.zeros((n, RECORD), np.uint8)
    wide = lambda c, kind, k: np.array(batch.column(c).to_pylist(), kind).reshape(n, k)
    xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).astype("<f4") if n else np.zeros((0, 3), "<f4")
    out[:, :12], out[:, 12:24] = xyz.view(np.uint8), wide("size", "<f4", 3).view(np.uint8)
    out[:, 24:28], out[:, 28:] = wide("rgba", np.uint8, 4), wide("turn", np.uint8, 4)
    return out.tobytes()


def write_packed(splats: DataFrame, path: str, highlight: bool = False, rgb: tuple[float, float, float] | None = None) -> int:
    """Records of 32 bytes; columns as in packed_columns. For a highlight splats has ``row``, which decides between equal opacities."""
    rows = packed_columns(splats, highlight, rgb)
    if highlight:  # ranges of opacity are partitions, and partitions follow each other in the file
        rows = rows.repartitionByRange(F.desc("opacity"), "row").sortWithinPartitions(F.desc("opacity"), "row")
    return onefile.write(rows.select("x", "y", "z", "size", "rgba", "turn"), path, lambda n: b"", F.lit(RECORD), _records)
