"""Dense arrays in .npy files, from rows that hold some of their cells."""

from __future__ import annotations

import io
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.sinks import onefile


def write_npy(rows: DataFrame, path: str, shape: tuple[int, ...], index: list[str], value: str, dtype: str = "<f4") -> int:
    """The array in C order; cells without a row are 0, and a cell given twice or outside the shape is an error.

    Cells are dealt by ranges of their place, so each task writes stretches of its own.
    """
    kind = np.dtype(dtype)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": tuple(shape)})
    opening, inside, at = head.getvalue(), F.lit(True), F.lit(0).cast("long")
    for n, c in zip(shape, index):
        inside, at = inside & (F.col(c) >= 0) & (F.col(c) < n), at * n + F.col(c)
    at: Column = F.when(inside, at).otherwise(F.raise_error(F.lit(f"a cell outside the shape {tuple(shape)}")))
    cells = rows.select(at.alias("at"), F.col(value).cast("double" if kind.kind == "f" else "long").alias("value")).repartitionByRange("at").sortWithinPartitions("at")
    with onefile.replacing(path, opening, len(opening) + kind.itemsize * prod(shape)) as other:

        def run(batches):
            before = -1
            with open(other, "r+b") as f:
                for batch in batches:
                    place = batch.column("at").to_numpy()
                    data = batch.column("value").fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                    if len(place) and (place[0] <= before or (np.diff(place) <= 0).any()):
                        raise ValueError("a cell is given twice")
                    cuts = np.flatnonzero(np.diff(place) != 1) + 1
                    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(place)].tolist()):
                        if b > a:
                            f.seek(len(opening) + kind.itemsize * int(place[a]))
                            f.write(data[a:b].tobytes())
                    before = int(place[-1]) if len(place) else before
                    yield pa.record_batch({"n": pa.array([len(place)], pa.int64())})

        return cells.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
