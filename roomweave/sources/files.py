"""Files around a reconstruction: images, named or largest files, video probes, training logs, arrays, camera transforms."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.sources import ranges

SLICE = 1 << 16  # values of an array in a batch


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, length, modified) of the files below the folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) in order of names: the jpg files or, where there is none, the png files."""
    jpg = _listed(spark, folder, "*.{jpg,jpeg,JPG,JPEG}")
    return (_listed(spark, folder, "*.{png,PNG}") if jpg.isEmpty() else jpg).select("path", "name").orderBy("name", "path")


def pick_file(spark: SparkSession, folder: str, pattern: str, named: list[str] = (), latest: bool = False) -> str | None:
    """The first of the named files that exists; else the largest (or latest) of the pattern, of equals the last by path."""
    files = _listed(spark, folder, pattern)
    place = F.array_position(F.array(*(F.lit(n) for n in named)).cast("array<string>"), F.col("name"))
    wanted, other = F.when(place > 0, place), F.struct("modified" if latest else "length", "path")
    found = files.agg(F.min_by("path", F.struct(wanted, "path")).alias("p"), F.min(wanted).alias("named"), F.max_by("path", other).alias("q")).first()
    if found.named is None:
        return found.q
    return files.where(F.col("name") == named[found.named - 1]).agg(F.min("path")).first()[0]


def require_files(spark: SparkSession, folder: str, names: list[str], pattern: str = "*") -> None:
    """Raises FileNotFoundError, with all that are missing, unless the folder holds every name."""
    held = {r.name for r in _listed(spark, folder, pattern).where(F.col("name").isin(*names)).select("name").distinct().collect()}  # as many as names
    if missing := [n for n in names if n not in held]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")


PROBE = ("streams array<struct<codec_type:string,r_frame_rate:string,duration:string,nb_frames:string,width:int,height:int,codec_name:string,pix_fmt:string>>,"
         "format struct<duration:string>")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, fps, duration_sec, total_frames, codec, pix_fmt) of the first video stream of each probe document.

    The rate is a number or a fraction (30 without one); the stream's duration goes before the file's; frames that are not
    counted are rate times duration, cut off. A document without a video stream is an error.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", PROBE).alias("d"))
    one = docs.select("file", F.get(F.filter("d.streams", lambda s: s.codec_type == "video"), F.lit(0)).alias("s"), F.col("d.format.duration").alias("whole"))
    part = F.split(F.coalesce("s.r_frame_rate", F.lit("30/1")), "/")
    fps = part[0].cast("double") / F.coalesce(F.get(part, F.lit(1)).cast("double"), F.lit(1.0))
    seconds = F.coalesce(F.col("s.duration").cast("double"), F.col("whole").cast("double"), F.lit(0.0))
    counted = F.nullif(F.coalesce(F.col("s.nb_frames").cast("long"), F.lit(0)), F.lit(0))
    width = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("no video stream in "), "file")).cast("int")).otherwise(F.coalesce("s.width", F.lit(0)))
    return one.select("file", width.alias("width"), F.coalesce("s.height", F.lit(0)).alias("height"), F.round(fps, 2).alias("fps"), F.round(seconds, 2).alias("duration_sec"),
                      F.coalesce(counted, (fps * seconds).cast("long")).alias("total_frames"), *(F.coalesce(f"s.{c}", F.lit("unknown")).alias(n) for c, n in (("codec_name", "codec"), ("pix_fmt", "pix_fmt"))))


#: How training logs write the measure.
PSNR = [r"[Pp][Ss][Nn][Rr]\s*[=:]\s*([\d.]+)", r"[Pp][Ss][Nn][Rr]\s+([\d.]+)", r"\"psnr\"\s*:\s*([\d.]+)"]


def read_training_logs(spark: SparkSession, path: str, above: float = 5.0, below: float = 60.0) -> DataFrame:
    """(file, values, final): the measures in each log, all of the first form, then of the second, then of the third; final is
    the last of them, null without any. Numbers outside the bounds do not count."""
    logs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = F.concat(*(F.regexp_extract_all("value", F.lit(p), F.lit(1)) for p in PSNR))
    values = F.filter(F.transform(found, lambda m: m.try_cast("double")), lambda v: (v > above) & (v < below))
    return logs.select("file", values.alias("values")).withColumn("final", F.try_element_at("values", F.lit(-1)))


def _npy_head(data: bytes):
    """(where values start, shape, in Fortran's order, type) of an array file."""
    f = io.BytesIO(data)
    major, _ = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return f.tell(), shape, fortran, kind


def read_npy(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    """(file, index, value): the values of array files with their place on each axis, from 0. A file is read in ranges of
    values by many tasks; in a store that only Spark reaches, by one."""

    def values(file: str, head: bytes, data: bytes, first: int):
        _, shape, fortran, kind = _npy_head(head)
        flat = np.frombuffer(data, kind).astype(np.float64)
        for a in range(0, len(flat), SLICE):
            some = flat[a : a + SLICE]
            places = np.arange(first + a, first + a + len(some))
            place = np.stack(np.unravel_index(places, shape, order="F" if fortran else "C"), 1) if shape else np.zeros((1, 0), np.int64)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * len(shape)
            index = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), index, pa.array(some)], ["file", "index", "value"])

    def cut(file: str, length: int):
        start, shape, _, kind = _npy_head(ranges.read_head(file))
        n = int(np.prod(shape, dtype=np.int64))
        if start + n * kind.itemsize > length:
            raise ValueError(f"{file} is cut short")
        yield from ranges.fixed(start, kind.itemsize, n, split)

    def read_ranges(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from values(r["file"], ranges.read_head(r["file"]), ranges.read_range(r["file"], r["start"], r["stop"]), r["first"])

    def read_contents(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                yield from values(file, data[: ranges.HEAD], data[_npy_head(data[: ranges.HEAD])[0] :], 0)

    schema, files = "file string, index array<int>, value double", ranges.listed(spark, path)
    one = files.first()
    if one is not None and ranges.reachable(one.file):
        return ranges.ranges(files, cut, split).mapInArrow(read_ranges, schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read_contents, schema)


TRANSFORMS = "fl_x double, fl_y double, cx double, cy double, w int, h int, frames array<struct<file_path:string,fl_x:double,fl_y:double,cx:double,cy:double,w:int,h:int,transform_matrix:array<array<double>>>>"


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(stem, r, t, fx, fy, cx, cy, width, height) of the frames of a transforms document, from the world to the camera.

    The document's poses go from the camera to the world with y up and z back; here y is down and z forward. A frame's own
    intrinsics other than zero go before the document's; fy is fx where it is not given.
    """
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", TRANSFORMS).alias("d")).select("d", F.explode("d.frames").alias("f"))
    m = lambda i, j: F.col("f.transform_matrix")[i][j]
    sign = (1.0, -1.0, -1.0)
    r = [sign[i] * m(j, i) for i in range(3) for j in range(3)]
    t = [-sum((r[3 * i + j] * m(j, 3) for j in range(3)), F.lit(0.0)) for i in range(3)]

    def own(name: str) -> Column:
        return F.coalesce(F.nullif(f"f.{name}", F.lit(0)), f"d.{name}")

    inner = [own("fl_x"), F.coalesce(own("fl_y"), own("fl_x")), own("cx"), own("cy"), own("w"), own("h")]
    stem = F.regexp_extract("f.file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return docs.select(stem.alias("stem"), F.array(*r).alias("r"), F.array(*t).alias("t"), *(c.alias(n) for c, n in zip(inner, ("fx", "fy", "cx", "cy", "width", "height"))))
