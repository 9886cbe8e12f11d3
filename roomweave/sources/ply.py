"""Point clouds and splats in PLY files, read and written as DataFrames.

A binary file whose rows have one width is read in ranges of rows by many tasks; a text file, or one with lists before
the element's end, by one.  In a store that only Spark reaches, a file is one row of the binaryFile source (at most 2 GB)
and is decoded by one task.  All files of one read have the header of the first; an unknown type is a KeyError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.sources import ranges

# Fixed values of the format: scalar types, their numpy codes and Spark types.
NUMPY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
         "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
HEAD, SLICE = 1 << 16, 100_000


@dataclass(frozen=True)
class Element:
    name: str
    rows: int
    fields: tuple[tuple[str, str], ...]  # names and numpy codes of scalar properties
    lists: tuple[tuple[int, str, str], ...]  # places among the properties, count type and value type


@dataclass(frozen=True)
class Header:
    kind: str
    size: int
    elements: tuple[Element, ...]

    def element(self, name: str) -> Element:
        found = [e for e in self.elements if e.name == name]
        if not found:
            raise ValueError(f"no element {name!r} among {[e.name for e in self.elements]}")
        return found[0]


def parse_header(data: bytes) -> Header:
    end = re.search(rb"(?m)^end_header\r?\n", data)
    if not data.startswith(b"ply") or end is None:
        raise ValueError("not a PLY file, or a header of more than 64 KB")
    kind, elements = "", []
    for line in data[: end.start()].decode("latin-1").splitlines()[1:]:
        match line.split():
            case ["format", which, *_]:
                kind = which
            case ["element", name, rows]:
                elements.append((name, int(rows), [], []))
            case ["property", "list", count, value, _]:
                elements[-1][3].append((len(elements[-1][2]) + len(elements[-1][3]), NUMPY[count], NUMPY[value]))
            case ["property", scalar, name]:
                elements[-1][2].append((name, NUMPY[scalar]))
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format {kind!r}")
    return Header(kind, end.end(), tuple(Element(n, r, tuple(f), tuple(x)) for n, r, f, x in elements))


def _skip_lists(data: bytes, at: int, e: Element, order: str, keep: bool) -> tuple[int, np.ndarray]:
    """The end of a binary element with list properties, and its scalars if wanted."""
    out = np.zeros(e.rows if keep else 0, dtype=[(n, c) for n, c in e.fields])
    lists, places = {k: (c, v) for k, c, v in e.lists}, range(len(e.fields) + len(e.lists))
    for row in range(e.rows):
        field = 0
        for k in places:
            if k in lists:
                count, value = (np.dtype(order + c) for c in lists[k])
                at += count.itemsize + int(np.frombuffer(data, count, 1, at)[0]) * value.itemsize
            else:
                name, code = e.fields[field]
                if keep:
                    out[name][row] = np.frombuffer(data, order + code, 1, at)[0]
                at += np.dtype(code).itemsize
                field += 1
    return at, out


def _binary(data: bytes, header: Header, name: str) -> np.ndarray:
    at, order = header.size, "<" if header.kind == "binary_little_endian" else ">"
    for e in header.elements:
        wanted = e.name == name
        if e.lists:
            at, rows = _skip_lists(data, at, e, order, wanted)
        else:
            kind = np.dtype([(n, order + c) for n, c in e.fields])
            if at + kind.itemsize * e.rows > len(data):
                raise ValueError(f"element {e.name!r} is cut short")
            rows = np.frombuffer(data, kind, e.rows, at) if wanted else None
            at += kind.itemsize * e.rows
        if wanted:
            return rows
    raise ValueError(f"no element {name!r}")


def _ascii(data: bytes, header: Header, name: str) -> np.ndarray:
    lines, at = data[header.size :].decode("latin-1").split("\n"), 0
    for e in header.elements:
        if e.name != name:
            at += e.rows
            continue
        out, lists = np.zeros(e.rows, dtype=[(n, c) for n, c in e.fields]), {k for k, *_ in e.lists}
        for row, line in enumerate(lines[at : at + e.rows]):
            words, k, scalars = line.split(), 0, []
            for place in range(len(e.fields) + len(e.lists)):
                if place in lists:
                    k += 1 + int(words[k])
                else:
                    scalars.append(words[k])
                    k += 1
            for (field, code), word in zip(e.fields, scalars):
                out[field][row] = float(word) if code[0] == "f" else int(float(word))
        return out
    raise ValueError(f"no element {name!r}")


def _place(header: Header, name: str) -> tuple[int, np.dtype] | None:
    """Where a binary element of rows of one width starts, and its rows' type; None where that takes reading."""
    at, order = header.size, "<" if header.kind == "binary_little_endian" else ">"
    for e in header.elements:
        if header.kind == "ascii" or e.lists:
            return None
        kind = np.dtype([(n, order + c) for n, c in e.fields])
        if e.name == name:
            return at, kind
        at += kind.itemsize * e.rows
    return None


def read_ply(spark: SparkSession, path: str, element: str = "vertex", split: int = ranges.SPLIT) -> DataFrame:
    """(file, row, one column a scalar property) of an element; list properties are skipped.

    An element of no rows gives none; a file with another header than the first, or one cut short, is an error.
    split: bytes of the range that a task reads.
    """
    files = ranges.listed(spark, path)
    one = files.first()
    if one is None:
        raise ValueError(f"no files at {path}")
    split_up = ranges.reachable(one.file)
    contents = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    head = ranges.read_head(one.file) if split_up else bytes(contents.select(F.substring("content", 1, HEAD).alias("head")).first().head)
    fields = parse_header(head).element(element).fields
    types = [SPARK[c] for _, c in fields]

    def held(file: str, data: bytes) -> Header:
        header = parse_header(data[:HEAD])
        if header.element(element).fields != fields:
            raise ValueError(f"{file} has other properties than the first file")
        return header

    def cut(file: str, length: int):
        header = held(file, ranges.read_head(file))
        found, rows = _place(header, element), header.element(element).rows
        if found is None:
            yield 0, length, 0, -1
        elif found[0] + found[1].itemsize * rows > length:
            raise ValueError(f"element {element!r} of {file} is cut short")
        else:
            yield from ranges.fixed(found[0], found[1].itemsize, rows, split)

    def batches_of(file: str, rows: np.ndarray, first: int = 0):
        for a in range(0, len(rows), SLICE):
            part = rows[a : a + SLICE]
            columns = [pa.array(part[n].astype(part[n].dtype.newbyteorder("=")), ARROW[t], safe=False) for (n, _), t in zip(fields, types)]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(first + a, first + a + len(part))), *columns], names=["file", "row", *(n for n, _ in fields)])

    def whole(file: str, data: bytes):
        header = held(file, data)
        yield from batches_of(file, (_ascii if header.kind == "ascii" else _binary)(data, header, element))

    def read_contents(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield from whole(file, content.as_py())

    def read_ranges(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = ranges.read_range(r["file"], r["start"], r["stop"])
                if r["n"] < 0:
                    yield from whole(r["file"], data)
                else:
                    _, kind = _place(held(r["file"], ranges.read_head(r["file"])), element)
                    yield from batches_of(r["file"], np.frombuffer(data, kind, r["n"]), r["first"])

    schema = ", ".join(["file string", "row bigint", *(f"`{n}` {t}" for (n, _), t in zip(fields, types))])
    return ranges.ranges(files, cut, split).mapInArrow(read_ranges, schema) if split_up else contents.mapInArrow(read_contents, schema)


def coloured(points: DataFrame, missing: int | None = 0, least: int = 0) -> DataFrame:
    """(file, row, x, y, z, red, green, blue) under the usual names of colours; missing colours get a fixed value, or
    are an error where it is None. Fewer than ``least`` points are an error; this reads the table once more."""
    names = {c.lower(): c for c in points.columns}
    if least and len(points.limit(least).select("row").collect()) < least:
        raise ValueError(f"fewer than {least} points")
    if missing is None and (lacks := [c for c in ("red", "green", "blue") if not {c, c[0], f"diffuse_{c}"} & names.keys()]):
        raise ValueError(f"no colours {', '.join(lacks)}")

    def colour(name: str) -> Column:
        known = [names[n] for n in (name, name[0], f"diffuse_{name}") if n in names]
        return (F.coalesce(F.col(known[0]), F.lit(missing)) if known else F.lit(missing)).cast("int").alias(name)

    return points.select("file", "row", *(F.col(names[c]).cast("double").alias(c) for c in "xyz"), *map(colour, ("red", "green", "blue")))


def ply_parts(rows: DataFrame, properties: dict[str, str], element: str = "vertex", part: str = "file") -> DataFrame:
    """(part, n_rows, content): one binary file for each slice of a partition, with scalar properties {column: type}.

    Slices hold SLICE rows, so nothing is gathered; a null is written as 0.  The files together hold each row once.
    """
    kind = np.dtype([(n, "<" + NUMPY[t]) for n, t in properties.items()])
    lines = "".join(f"property {t} {n}\n" for n, t in properties.items())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                some = batch.slice(a, SLICE)
                out = np.zeros(some.num_rows, dtype=kind)
                for n in properties:
                    out[n] = some.column(n).fill_null(0).to_numpy(zero_copy_only=False)
                head = f"ply\nformat binary_little_endian 1.0\nelement {element} {len(out)}\n{lines}end_header\n".encode()
                yield pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64()), pa.array([head + out.tobytes()], pa.binary())], names=["n_rows", "content"])

    made = rows.select(*(F.col(n) for n in properties)).mapInArrow(run, "n_rows bigint, content binary")
    return made.select(F.format_string("part-%012d.ply", F.monotonically_increasing_id()).alias(part), "n_rows", "content")
