"""Files in byte ranges, so that one large file is read by many tasks.

Where Python reaches the store itself (a mount, or what pyarrow has a file system for), tasks read the ranges they are
given; elsewhere callers fall back on Spark's binaryFile source, whose rows are whole files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 1 << 16
SPLIT = 16 << 20  # bytes of a range
MOST = 10_000  # partitions of ranges
RANGE = "file string, start bigint, stop bigint, first bigint, n bigint"


def _store(path: str):
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    try:
        store, name = _store(path)
        return store.get_file_info(name).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def read_range(path: str, start: int, stop: int) -> bytes:
    store, name = _store(path)
    with store.open_input_file(name) as f:
        return f.read_at(stop - start, start)


def read_head(path: str) -> bytes:
    store, name = _store(path)
    with store.open_input_file(name) as f:
        return f.read_at(min(HEAD, f.size()), 0)


def pieces(path: str, start: int, size: int = 8 << 20) -> Iterator[bytes]:
    """The file from start on, in pieces of a bounded size."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        while data := f.read(size):
            yield data


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files at the path; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def ranges(files: DataFrame, cut: Callable[[str, int], Iterator[tuple[int, int, int, int]]], split: int = SPLIT) -> DataFrame:
    """(file, start, stop, first, n) of each file as cut(file, length) finds them: bytes, the first record's number, and records.

    A file is cut by one task, which reads no more than it needs to find its records; ranges are then dealt to many.
    """

    def run(batches):
        for batch in batches:
            for file, length in zip(*(batch.column(c).to_pylist() for c in ("file", "length"))):
                found = list(zip(*cut(file, length)))
                if found:
                    yield pa.record_batch([pa.array([file] * len(found[0])), *(pa.array(c, pa.int64()) for c in found)], names=["file", "start", "stop", "first", "n"])

    total = files.agg(F.sum("length")).first()[0] or 0
    return files.mapInArrow(run, RANGE).repartition(max(1, min(MOST, -(-total // split))))


def fixed(start: int, width: int, rows: int, split: int = SPLIT) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of records of one width."""
    step = max(1, split // max(1, width))
    for a in range(0, rows, step):
        b = min(rows, a + step)
        yield start + a * width, start + b * width, a, b - a
