"""Cameras from whichever of several files is there: transforms, pose documents with intrinsics, lines of keyframes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.functions.geometry import quaternion_matrix
from roomweave.sources.files import read_transforms

CAMERA = ("frame", "x", "y", "z", "r", "fx", "fy", "cx", "cy")
#: Intrinsics of keyframes without any.
USUAL = (600.0, 600.0, 320.0, 240.0)


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """CAMERA of lines ``tx ty tz qx qy qz qw``, with a name before or not; r turns from the camera to the world.

    Blank lines, comments (#) and lines of other lengths are left out; a line without a name is named by its number from 0
    among those that are no comment.  Quaternions are normalised; a line with a zero one or a word that is no number has null.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.btrim(s)), lambda s: (s != "") & ~s.startswith("#"))).alias("n", "line"))
    words = text.select("n", F.split("line", r"\s+").alias("w")).where(F.size("w").isin(7, 8))
    v = [F.element_at("w", k - 8).try_cast("double") for k in range(1, 8)]
    name = F.when(F.size("w") == 8, F.element_at("w", 1)).otherwise(F.col("n").cast("string"))
    return words.select(name.alias("frame"), *(v[k].alias(c) for k, c in enumerate("xyz")), F.array(*quaternion_matrix(v[6], *v[3:6])).alias("r"), *(F.lit(x).alias(c) for x, c in zip(USUAL, CAMERA[5:])))


def read_pose_cameras(spark: SparkSession, path: str) -> DataFrame:
    """CAMERA of a document {name: {cam_to_world_4x4, intrinsic_3x3}}; entries that lack one, or of another shape, are left out."""
    matrix = "array<array<double>>"
    entry = F.from_json("raw", f"struct<cam_to_world_4x4: {matrix}, intrinsic_3x3: {matrix}>")
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "raw")).select("name", entry.alias("p"))
    shape = lambda c, n: F.coalesce((F.size(c) == n) & F.forall(c, lambda r: F.size(r) == n), F.lit(False))
    docs = docs.where(shape("p.cam_to_world_4x4", 4) & shape("p.intrinsic_3x3", 3))
    m, k = (lambda i, j: F.col("p.cam_to_world_4x4")[i][j]), (lambda i, j: F.col("p.intrinsic_3x3")[i][j])
    return docs.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("frame"), *(m(i, 3).alias(c) for i, c in enumerate("xyz")), F.array(*(m(i, j) for i in range(3) for j in range(3))).alias("r"),
                       k(0, 0).alias("fx"), k(1, 1).alias("fy"), k(0, 2).alias("cx"), k(1, 2).alias("cy"))


def read_transform_cameras(spark: SparkSession, path: str) -> DataFrame:
    """CAMERA of a transforms document; r here turns from the camera (y down, z ahead) to the world."""
    t = read_transforms(spark, path)
    r = lambda i, j: F.col("r")[3 * i + j]
    centre = [-sum((r(k, i) * F.col("t")[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return t.select(F.col("stem").alias("frame"), *(c.alias(n) for c, n in zip(centre, "xyz")), F.array(*(r(j, i) for i in range(3) for j in range(3))).alias("r"), "fx", "fy", "cx", "cy")


#: Names of camera files, by preference.
KINDS: tuple[tuple[str, Callable], ...] = (
    ("cameras.json", read_transform_cameras), ("transforms.json", read_transform_cameras), ("transforms_train.json", read_transform_cameras),
    ("camera_poses.json", read_pose_cameras), ("room_video.txt", read_keyframes),
)


def first_cameras(spark: SparkSession, folders: list[str], kinds: tuple[tuple[str, Callable], ...] = KINDS) -> tuple[str | None, DataFrame | None]:
    """The path and CAMERA of the first file that has a camera: kinds by preference, each in the folders in turn; (None, None) without any."""
    for name, read in kinds:
        for folder in folders:
            path = f"{folder}/{name}"
            listed = spark.read.format("binaryFile").option("pathGlobFilter", name)
            try:
                held = not listed.load(folder).select("path").isEmpty()
            except Exception as e:  # a folder that is not there
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            if held and not (cameras := read(spark, path)).isEmpty():
                return path, cameras
    return None, None
