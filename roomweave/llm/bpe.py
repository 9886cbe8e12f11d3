"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is halved down to leaves, leaves are encoded by the public vocabulary, and neighbours are joined: a window
around their border is encoded again and grows until the tokens outside it provably cannot change.

Why they cannot: no match of the splitting pattern holds white space after another character, so the place between
a character that is not white space and one that is always lies between two matches, whatever stands around it.  To
the left of such a place in the left half and to the right of one in the right half, each half's own tokens are those
of the whole.  The window doubles until it holds such places, or all of a half.

Joining is associative, with the empty text as neutral element, so any tree gives the same ids.  Decoding joins the
bytes of halves.  Null texts count as empty and give no tokens; strings that look like special tokens are plain text.
Each row is encoded, also repeated ones and rows of equal or null id; other columns stay, but for one of the new name,
which is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 512  # characters, or ids, up to which the library takes a part whole
FIRST_WINDOW = 64
ROWS = 64  # rows of an output batch
_BETWEEN = re.compile(r"(?<=\S)[ \n\t]")


@cache
def encoding(path: str):
    """The vocabulary at path (a .tiktoken file of ranks), loaded once in each worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def join(encode, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """The ids of left + right, from theirs."""
    if not left or not right:
        return left_ids + right_ids
    width = FIRST_WINDOW
    while True:
        tail, head = left[-width:], right[:width]
        cuts = [m.start() for m in _BETWEEN.finditer(tail)]
        p = cuts[-1] if cuts else 0 if width >= len(left) else None
        m = _BETWEEN.search(head)
        q = m.start() if m else len(right) if width >= len(right) else None
        if p is not None and q is not None:
            break
        width *= 2
    tail, head = tail[p:], right[:q]
    keep = len(left_ids) - len(encode(tail))
    return left_ids[:keep] + encode(tail + head) + right_ids[len(encode(head)):]


def encode_tree(encode, text: str, leaf: int = LEAF) -> list[int]:
    if len(text) <= leaf:
        return encode(text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(encode, left, encode_tree(encode, left, leaf), right, encode_tree(encode, right, leaf))


def decode_tree(decode, ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return decode(ids)
    half = len(ids) // 2
    return decode_tree(decode, ids[:half], leaf) + decode_tree(decode, ids[half:], leaf)


def _mapped(df: DataFrame, column: str, new: str, work) -> DataFrame:
    """df with another column ``new``, which work() makes of the values of ``column``, a few rows at a time."""
    df = df if new == column else df.drop(new)
    kept = [c for c in df.columns if c != new]
    schema = df.select(*kept, F.lit(b"").alias(new)).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = work(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(made, type=pa.binary())], names=[*kept, new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a binary column of token ids, as little-endian unsigned 32-bit integers."""

    def work(texts):
        one = encoding(path).encode_ordinary
        return [array("I", encode_tree(one, t or "")).tobytes() for t in texts]

    return _mapped(df, text, ids, work)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for."""

    def work(values):
        one = encoding(path).decode_bytes
        return [decode_tree(one, array("I", v or b"").tolist()) for v in values]

    return _mapped(df, ids, decoded, work)
