"""The folder of checkpoints: the one that the session names, or a local one where it names none and runs on one machine."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def set_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of checkpoints: computed once, for a large result that is read more than once."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new name of a folder within that of checkpoints, for files that are written and read again."""
    set_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid4().hex}"
