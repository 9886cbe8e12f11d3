"""One file written by all tasks at once, each at its own place.

The rows are checkpointed, a row a partition says how many they are and how many bytes they take, and from these sums
follow the file's opening and the place of each partition.  A task writes its records there and nowhere else, so a
task that runs again writes the same bytes, and neither records nor parts of the file pass the driver.  The file has
another name until all is written: where a task fails for good, nothing is left.

The path must be in a folder that driver and executors share and that takes writes at any place, such as a mount.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.storage import set_checkpoint_dir


def local(path: str) -> str:
    """The path as the system knows it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path}: a file of one piece needs a shared folder that takes writes at any place")
    return "/" + rest.lstrip("/")


@contextmanager
def replacing(path: str, opening: bytes, size: int):
    """Another name for the file, of this opening and size with zeros behind it; path gets it at the end, or it goes."""
    target = local(path)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    other = f"{target}.{uuid4().hex}.tmp"
    try:
        with open(other, "wb") as f:
            f.write(opening)
            f.truncate(size)
        yield other
        os.replace(other, target)
    finally:
        if os.path.exists(other):
            os.unlink(other)


def write(rows: DataFrame, path: str, opening: Callable[[int], bytes], size: Column, encode: Callable[[pa.RecordBatch], bytes]) -> int:
    """Write the rows in their order (partition by partition) and return their number.

    opening: the file's first bytes for a number of rows; size: a row's bytes; encode: the records of a batch.
    """
    set_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    found = {r.part: (r.n, r.size) for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()}  # a row a partition
    total = sum(n for n, _ in found.values())
    head = opening(total)
    at, places = len(head), {}
    for part in sorted(found):
        places[part] = (at, at + found[part][1])
        at += found[part][1]
    with replacing(path, head, at) as other:

        def run(batches: Iterable[pa.RecordBatch]):
            from pyspark import TaskContext

            start, stop = places.get(TaskContext.get().partitionId(), (0, 0))
            n = 0
            with open(other, "r+b") as f:
                f.seek(start)
                for batch in batches:
                    data = encode(batch)
                    if f.tell() + len(data) > stop:
                        raise ValueError(f"records of {path} take more bytes than were counted")
                    f.write(data)
                    n += batch.num_rows
                if n and f.tell() != stop:
                    raise ValueError(f"records of {path} take fewer bytes than were counted")
            yield pa.record_batch({"n": pa.array([n], pa.int64())})

        written = rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
        if written != total:
            raise ValueError(f"{written} of {total} rows of {path} were written")
    return total
