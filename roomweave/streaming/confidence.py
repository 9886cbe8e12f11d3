"""The confidence map as points arrive.

Each cell's count is keyed state.  A micro-batch hands on the cells that it changed; they are merged with the table of all
counts, and density is taken anew from it, since its scale, a percentile of all cells, moves with every batch.  Points
later than the watermark are left out.  Each batch writes a version of its own and reads the one before, so a batch that
runs again after a failure writes the same version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roomweave.operators import voxels

COUNTS = "i int, j int, k int, n long"


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
    state.update((n,))
    yield pd.DataFrame({"i": [key[0]], "j": [key[1]], "k": [key[2]], "n": [n]})


def running_counts(points: DataFrame, shape: DataFrame, size: float, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(i, j, k, n) of the cells of the grid that a micro-batch adds points to: all points so far, less those too late.

    State holds a number a filled cell.
    """
    placed = voxels.to_cells(points.withWatermark(time, late), shape, size).select("i", "j", "k", time)
    return placed.groupBy("i", "j", "k").applyInPandasWithState(_add, COUNTS, "n long", "update", GroupStateTimeout.EventTimeTimeout)


def version(spark: SparkSession, folder: str, batch: int, table: str = "confidence") -> DataFrame:
    return spark.read.parquet(f"{folder}/{batch}/{table}")


def keep_confidence(changed: DataFrame, folder: str, covered: DataFrame) -> DataStreamWriter:
    """A writer that leaves, for each batch, the tables counts (i, j, k, n) and confidence (i, j, k, confidence) in folder/<batch>.

    changed: of running_counts; covered: coverage (i, j, k, coverage) of the cameras.  Older versions than the last but one
    are not read again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.select("i", "j", "k", "n")
        if number > 0:
            counts = version(spark, folder, number - 1, "counts").join(counts, ["i", "j", "k"], "left_anti").unionByName(counts)
        counts.write.mode("overwrite").parquet(f"{folder}/{number}/counts")
        dense = voxels.relative(version(spark, folder, number, "counts"))
        voxels.confidence(dense, covered).write.mode("overwrite").parquet(f"{folder}/{number}/confidence")

    return changed.writeStream.outputMode("update").foreachBatch(merge)
