"""Packing of documents into training sequences with even attention cost.

Each task tokenises its documents in stream order and packs them window by window, so that neither texts nor ids are
shuffled and memory stays bounded.  Within a window, documents are cut at ``length`` tokens; what remains of each goes,
longest first, to the sequence of least cost (linear plus quadratic) that still has room.  There are just enough
sequences for all tokens; a piece that fits none is cut to fill the cheapest.  So a window pads less than one sequence.

Null texts count as empty: such a document is the end token alone.  Each row is packed, also rows with equal or null
id.  Sequence ids hold the task's number and a running number, so they are unique; they depend on how Spark splits
the input.  A task that is run again gives the same rows.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_TOKENS = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


@cache
def encoder(path: str):
    """text -> ids by the tokenizers file at path (byte-level BPE); its special tokens' strings give their ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # Bytes are written as printable characters: themselves where printable, others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return encode


def assign(lengths: list[int], length: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) of each piece, and the number of sequences."""
    pieces, rest, n = [], [], 0
    for i, size in enumerate(lengths):
        for start in range(0, size - length + 1, length):
            pieces.append((i, start, length, n, 0))
            n += 1
        if size % length:
            rest.append((size % length, i, size - size % length))
    k = -(-sum(r[0] for r in rest) // length)
    heap, used = [(0.0, n + j) for j in range(k)], [0] * k
    rest.sort(key=lambda r: (-r[0], r[1]))
    for size, i, start in rest:
        while size:
            aside = []
            while heap and length - used[heap[0][1] - n] < size:
                aside.append(heapq.heappop(heap))
            if not heap:  # it fits nowhere: cut it to fill the cheapest
                heap, aside = aside, []
                heapq.heapify(heap)
            cost, j = heapq.heappop(heap)
            part = min(size, length - used[j - n])
            pieces.append((i, start, part, j, used[j - n]))
            used[j - n] += part
            if used[j - n] < length:
                heapq.heappush(heap, (cost + LINEAR * part + QUADRATIC * part * part, j))
            for x in aside:
                heapq.heappush(heap, x)
            size, start = size - part, start + part
    return pieces, n + k


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: its document, place there, sequence and place there; with_ids adds its ids (binary)."""
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        encode, task, n = encoder(path), TaskContext.get().partitionId(), 0

        def flush(ids, tokens):
            nonlocal n
            pieces, made = assign([len(t) for t in tokens], length)
            rows = []
            for i, start, size, sequence, offset in pieces:
                part = tokens[i][start : start + size].tobytes()
                rows.append((ids[i], start, size, zlib.crc32(part), len(tokens[i]), (task << 33) + n + sequence, offset, part)[: len(names)])
            n += made
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

        ids, tokens, total = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = array("I", encode(t or ""))
                    own.append(end_id)
                    ids.append(i)
                    tokens.append(own)
                    total += len(own)
                    if total >= WINDOW_TOKENS:
                        yield flush(ids, tokens)
                        ids, tokens, total = [], [], 0
        if ids:
            yield flush(ids, tokens)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)
