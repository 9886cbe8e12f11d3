"""Annotations of frames: a JSON document a frame, {label: {bbox, confidence, mask_rle: {size, counts}}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<bbox:array<double>,confidence:double,mask_rle:struct<size:array<int>,counts:string>>"


def frame_number(stem):
    """The whole number after the last "frame_", so that frame_0058 is frame_00058; null where there is none."""
    return F.regexp_replace(stem, "^.*frame_", "").try_cast("int")


def read_semantics(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, frame, ord, label, x, y, w, h, conf, mask_height, mask_width, counts) of the entries of each document;
    counts is the text of the run lengths, a string in COCO's form or a JSON list. Empty documents give no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    rows = docs.select("file", stem.alias("stem"), F.posexplode(F.map_entries(F.from_json("value", f"map<string,{ENTRY}>"))).alias("ord", "e"))
    box = [F.get("e.value.bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")]
    size = [F.get("e.value.mask_rle.size", F.lit(k)).alias(c) for k, c in enumerate(("mask_height", "mask_width"))]
    return rows.select("file", "stem", frame_number(F.col("stem")).alias("frame"), "ord", F.col("e.key").alias("label"), *box, F.coalesce("e.value.confidence", F.lit(0.0)).alias("conf"), *size, F.col("e.value.mask_rle.counts").alias("counts"))


def last_of_number(rows: DataFrame) -> DataFrame:
    """Of files with one frame number, the last by name; rows without a number are left out."""
    numbered = rows.where("frame IS NOT NULL")
    return numbered.join(numbered.groupBy("frame").agg(F.max("file").alias("file")), ["frame", "file"], "left_semi")


def with_poses(rows: DataFrame, poses: DataFrame) -> DataFrame:
    """Entries beside the pose whose name without folder and ending is their stem; entries without a pose are left out.

    poses: (name, ...); poses are few to entries, and of several with one stem each entry gets all.
    """
    stem = F.regexp_extract("name", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return rows.join(poses.withColumn("stem", stem), "stem")
