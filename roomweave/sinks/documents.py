"""JSON documents and tables of text as single files: what they hold is a summary of bounded size."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.sinks import onefile

MOST_BYTES = 64 << 20


def write_document(document: DataFrame, path: str, indent: int = 2) -> None:
    """The one JSON string of a one-row table, indented. Over MOST_BYTES it is an error: write such a table with Spark's own sinks."""
    column = document.columns[0]
    size = document.agg(F.count("*").alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    if size.n != 1 or size.b is None or size.b > MOST_BYTES:
        raise ValueError(f"{size.n} rows of {size.b} bytes are no document")
    text = json.dumps(json.loads(document.first()[0]), indent=indent, ensure_ascii=False)
    with onefile.replacing(path, text.encode() + b"\n", len(text.encode()) + 1):
        pass


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> int:
    """One file with a heading, in the order of rows; fields are quoted where they must be."""
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    lines = rows.select(F.concat(F.concat_ws(",", *quoted), F.lit("\n")).alias("line"))

    def encode(batch: pa.RecordBatch) -> bytes:
        return "".join(batch.column("line").to_pylist()).encode()

    return onefile.write(lines, path, lambda n: (",".join(columns) + "\n").encode(), F.octet_length("line").cast("long"), encode)
