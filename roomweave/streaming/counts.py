"""Points a voxel as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.functions.geometry import bucket


def voxel_counts(points: DataFrame, size: float, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, i, j, k, n): points a cell and window of event time. A window is given out once when the watermark has
    passed its end; points later than that are left out. State holds the cells of open windows only."""
    cells = [bucket(F.col(c), size).alias(n) for n, c in zip("ijk", "xyz")]
    counted = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *cells).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "i", "j", "k", "n")
