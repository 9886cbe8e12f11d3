"""Camera poses from text trajectories and JSON, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.functions.geometry import quaternion_matrix

MATRIX = "array<array<double>>"


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, tx, ty, tz, qx, qy, qz, qw) of lines ``ts tx ty tz qx qy qz qw``.

    Blank lines, comments (#) and lines of fewer than eight words are left out; a word that is no number is null.
    """
    words = F.split(F.btrim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.btrim("value").startswith("#")).select(F.col("_metadata.file_path").alias("file"), words.alias("w")).where(F.size("w") >= 8)
    names = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    return lines.select("file", *(F.element_at("w", k).try_cast("double").alias(n) for k, n in enumerate(names, 1)))


def trajectory_matrices(poses: DataFrame) -> DataFrame:
    """The poses with cam_to_world, a 4 x 4 array of rows; quaternions are normalised, zero ones give null."""
    length = F.sqrt(sum((F.col(q) * F.col(q) for q in ("qw", "qx", "qy", "qz")), F.lit(0.0)))
    unit = [F.col(q) / F.nullif(length, F.lit(0.0)) for q in ("qw", "qx", "qy", "qz")]
    r = quaternion_matrix(*unit)
    rows = [F.array(*r[3 * k : 3 * k + 3], F.col(t)) for k, t in enumerate(("tx", "ty", "tz"))]
    last = F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))
    return poses.withColumn("cam_to_world", F.when(length > 0, F.array(*rows, last)))


def invert_rigid(matrix) -> F.Column:
    """The inverse of a 4 x 4 rotation with translation, as array rows: the transpose, and minus it times the translation."""
    m = lambda i, j: matrix[i][j]
    rows = [F.array(*(m(j, i) for j in range(3)), -(m(0, i) * m(0, 3) + m(1, i) * m(1, 3) + m(2, i) * m(2, 3))) for i in range(3)]
    return F.array(*rows, F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))


def read_pose_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, cam_to_world) from JSON documents of either layout:

    {name: {cam_to_world_4x4 | world_to_cam_4x4 | extrinsic_4x4}} or {"frames": [{file_path, transform_matrix}]}.
    The inverse of world_to_cam or extrinsic stands in where cam_to_world is missing; entries without any are left out.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))
    frames = docs.select("file", F.from_json("doc", f"frames array<struct<file_path string, transform_matrix {MATRIX}>>").alias("d")).select("file", F.explode("d.frames").alias("f"))
    listed = frames.select("file", F.col("f.file_path").alias("name"), F.col("f.transform_matrix").alias("cam_to_world"))
    entry = f"struct<cam_to_world_4x4 {MATRIX}, world_to_cam_4x4 {MATRIX}, extrinsic_4x4 {MATRIX}>".replace("_4x4 ", "_4x4: ")
    by_name = (docs.where(F.get_json_object("doc", "$.frames").isNull()).select("file", F.explode(F.from_json("doc", f"map<string, string>")).alias("name", "raw"))
               .select("file", "name", F.from_json("raw", entry).alias("p")))
    inverse = F.coalesce("p.world_to_cam_4x4", "p.extrinsic_4x4")
    named = by_name.select("file", "name", F.coalesce("p.cam_to_world_4x4", F.when(inverse.isNotNull(), invert_rigid(inverse))).alias("cam_to_world"))
    return named.unionByName(listed).where("cam_to_world IS NOT NULL")
