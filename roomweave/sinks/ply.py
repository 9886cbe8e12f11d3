"""PLY files of one piece: point clouds, splats, and other files' headers with new rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.sinks import onefile
from roomweave.sources.ply import NUMPY, Header, parse_header
from roomweave.sources.ranges import read_head
from roomweave.sources.splat import splat_columns, splat_properties

#: Properties of a coloured point cloud.
POINTS = {"x": "float", "y": "float", "z": "float", "red": "uchar", "green": "uchar", "blue": "uchar"}


def _records(kind: np.dtype):
    def encode(batch: pa.RecordBatch) -> bytes:
        out = np.zeros(batch.num_rows, dtype=kind)
        for n in kind.names:
            out[n] = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
        return out.tobytes()

    return encode


def write_ply(rows: DataFrame, path: str, properties: dict[str, str] = POINTS, element: str = "vertex") -> int:
    """A little-endian file of the columns {property: type}, in the order of rows; a null is written as 0."""
    kind = np.dtype([(n, "<" + NUMPY[t]) for n, t in properties.items()])
    lines = "".join(f"property {t} {n}\n" for n, t in properties.items())
    head = lambda n: f"ply\nformat binary_little_endian 1.0\nelement {element} {n}\n{lines}end_header\n".encode()
    return onefile.write(rows.select(*properties), path, head, F.lit(kind.itemsize), _records(kind))


def write_tagged(rows: DataFrame, path: str, properties: dict[str, str], tag: str = "confidence_tag") -> int:
    """The file with a byte for each row's tag behind its other properties."""
    return write_ply(rows, path, {**{n: t for n, t in properties.items() if n != tag}, tag: "uchar"})


def write_splats(splats: DataFrame, path: str, n_rest: int = 0) -> int:
    """Splats with all normals 0; f_rest has n_rest values."""
    return write_ply(splat_columns(splats, n_rest), path, splat_properties(n_rest))


def rewrite_ply(rows: DataFrame, like: str, path: str, element: str = "vertex") -> int:
    """A file with the header of another, comments and all, in which only the number of rows is another.

    rows has a column for each of its properties.  Text files, list properties and other elements with rows are errors.
    """
    data = read_head(like)
    header: Header = parse_header(data)
    found = header.element(element)
    if header.kind == "ascii" or found.lists or any(e.rows for e in header.elements if e.name != element):
        raise ValueError(f"{like}: only a binary file of one element without lists can be written anew")
    order = "<" if header.kind == "binary_little_endian" else ">"
    kind = np.dtype([(n, order + c) for n, c in found.fields])
    number = re.compile(rb"(?m)^(element[ \t]+" + re.escape(element.encode()) + rb"[ \t]+)[0-9]+")
    head = lambda n: number.sub(lambda m: m[1] + str(n).encode(), data[: header.size], count=1)
    return onefile.write(rows.select(*kind.names), path, head, F.lit(kind.itemsize), _records(kind))
