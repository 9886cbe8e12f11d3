"""Removal of lines that several documents share.

Lines are exploded and normalised, two 64-bit hashes stand for each, distinct documents are counted per hash with
partial sums on the map side, and lines over the threshold go from all documents but the smallest that holds them.
Only (hashes, document, position) is shuffled; a line that a third of all documents hold is one row on the counted
side of the join, and the other side can be split.  The text moves once, to meet its positions.

Null and empty texts are one empty line.  Lines shorter than ``min_chars`` after normalising always stay, in their
place; equal lines of one document count once and are dropped together.  Rows with a null id hold no document: their
lines neither count nor go.  Rows with equal id count as one document.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(SPACE)), ascii_uppercase, ascii_lowercase)


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_docs: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs in a struct ``row``, with n_lines, n_dropped and kept (the remaining lines).

    A line goes if its key has at least min_chars code points and more than max_docs documents hold it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(whole).alias("version"), F.split(whole, "\n", -1).alias("lines"))
    key = line_key(F.col("line"))
    lines = (docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("version"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
             .where(F.col("id").isNotNull() & (F.char_length("line") >= min_chars))
             .select("id", "version", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
             .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    holders = (lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("id").alias("first"))
               .where(F.col("n_docs") > max_docs))
    dropped = (lines.join(holders, ["h1", "h2"]).where(F.col("id") != F.col("first"))
               .groupBy("id", "version").agg(F.collect_set("pos").alias("drop")))
    none = F.array().cast("array<int>")
    drop = F.coalesce(F.col("drop"), none)
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), drop)
    return base.join(dropped, ["id", "version"], "left").select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"),
        F.when(F.size(drop) == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")).alias("kept"))
