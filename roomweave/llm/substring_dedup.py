"""Removal of repeated word sequences between documents, by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words, which form the index; every rolling window of
``block`` words of every document probes it.  A repeat of ``window >= 2 * block - 1`` words always holds a whole block
of the document it is copied from, so no repeat goes unnoticed.  Hits are then extended: all windows of ``window``
words around hits are compared by their own hash, the smallest document that holds each is found, and overlapping
windows make up the maximal repeats, which are removed from all but that document.

Spark deals the work by a hash of the document id into groups of about ``GROUP_BYTES`` of text, and by a hash of the
word sequence into buckets.  A group sends each bucket its distinct hashes only, packed into one binary value, so a
passage that a third of all documents share weighs one entry a group.  The number of groups, of buckets and the width
of the anchors' fingerprints follow from the measured size of the input.

Null or empty texts have no words and lose none.  Repeats within one document stay, since only smaller document ids
count.  Rows that share a document id count as one document; each row gives a row.  Rows without an id
are compared with none and keep all their words.  Word sequences are compared by
64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.llm.wordhash import U, Words

GROUP_BYTES = 6 << 20
ENTRIES = "bucket int, grp int, entries binary"
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    few = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(few), 8), dtype=np.uint8)
    wide[:, :width] = few
    return wide.reshape(-1).view("<u8")


def _dealt(bucket: np.ndarray, order: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) for each bucket that occurs; order: indices by bucket."""
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in range(n) if cuts[k + 1] > cuts[k]]


def _table(names_types: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names_types)
    return pa.table({n: pa.array(c, type=t) for (n, t), c in zip(names_types, columns)})


PACK = [("bucket", pa.int32()), ("grp", pa.int32()), ("entries", pa.binary())]


class _Plan:
    """The sizes that all steps agree on."""

    def __init__(self, window: int, block: int, n_bytes: int):
        if window < 2 * block - 1:
            raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
        self.window, self.block = window, block
        self.parts = max(1, -(-n_bytes // GROUP_BYTES))
        # Of the anchors' fingerprints: enough for about one chance hit in 2**14 probes.
        self.bits = min(62, max(24, int(n_bytes // (5 * block) + 1).bit_length() + 14))
        rest = ((1 << self.bits) - 1) // self.parts
        self.width = -(-(rest.bit_length() + 2) // 8)

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        hashes, whole = words.windows(self.block)
        return hashes >> U(64 - self.bits), whole

    def send_anchors(self, table: pa.Table) -> pa.Table:
        """Each distinct rolling block of a group: is it an index block, and do several documents hold it?"""
        words, grp = Words(table["text"]), table["grp"][0].as_py()
        keys, whole = self.anchors(words)
        if not len(keys):
            return _table(PACK, [])
        n = len(keys)
        doc = table["doc_id"].to_numpy()[words.text_of_word()[:n]]
        place = np.arange(n) - words.first[words.text_of_word()[:n]]
        aligned = (place % self.block == 0)[whole]
        keys, doc = keys[whole], doc[whole]
        order = np.argsort(keys, kind="stable")
        keys, doc, aligned = keys[order], doc[order], aligned[order]
        if not len(keys):
            return _table(PACK, [])
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
        index = np.logical_or.reduceat(aligned, new)
        keys = keys[new]
        bucket, rest = (keys % U(self.parts)).astype(np.int64), keys // U(self.parts)
        entry = (rest << U(2)) | (index.astype(U) << U(1)) | many.astype(U)
        order = np.lexsort((entry, bucket))
        return _table(PACK, [(k, grp, _packed(entry[i], self.width)) for k, i in _dealt(bucket, order, self.parts)])

    def match_anchors(self, table: pa.Table) -> pa.Table:
        """For each group its blocks that are index blocks somewhere and that several documents hold."""
        bucket = table["bucket"][0].as_py()
        lists = [_unpacked(x, self.width) for x in table["entries"].to_pylist()]
        entry = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(entry, kind="stable")
        rest = entry[order] >> U(2)
        new = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        size = np.diff(np.r_[new, len(rest)])
        flags = np.bitwise_or.reduceat(entry[order] & U(3), new)
        hit = np.repeat((flags >= U(2)) & ((size > 1) | (flags == U(3))), size)
        found, owner = rest[hit], owner[order][hit]
        grps, order = table["grp"].to_pylist(), np.argsort(owner, kind="stable")
        return _table(PACK, [(bucket, grps[k], _packed(found[i], self.width)) for k, i in _dealt(owner, order, len(grps))])

    def send_windows(self, key: tuple, table: pa.Table, hits: pa.Table) -> pa.Table:
        """Each distinct window that holds a hit, with the smallest document of the group that holds it."""
        if not table.num_rows or not hits.num_rows:
            return _table(PACK, [])
        words, grp = Words(table["text"]), table["grp"][0].as_py()
        shared = np.sort(np.concatenate([_unpacked(e, self.width) * U(self.parts) + U(b) for b, e in zip(hits["bucket"].to_pylist(), hits["entries"].to_pylist())]))
        keys, whole = self.anchors(words)
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        hit = whole & (shared[at] == keys)
        hashes, whole = words.windows(self.window)
        if not len(hashes):
            return _table(PACK, [])
        count = np.r_[0, np.cumsum(hit)]
        n, reach = len(hashes), self.window - self.block + 1
        near = whole & (count[np.minimum(np.arange(n) + reach, len(hit))] > count[:n])
        doc = table["doc_id"].to_numpy()[words.text_of_word()[:n]][near]
        hashes = hashes[near]
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        if not len(hashes):
            return _table(PACK, [])
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        hashes, doc = hashes[new], doc[new]
        bucket = (hashes % U(self.parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return _table(PACK, [(k, grp, hashes[i].tobytes() + doc[i].astype("<i8").tobytes()) for k, i in _dealt(bucket, order, self.parts)])

    def match_windows(self, table: pa.Table) -> pa.Table:
        """For each group its windows that a smaller document of another group holds, with the smallest such."""
        bucket = table["bucket"][0].as_py()
        lists = [np.frombuffer(x, dtype="<u8").reshape(2, -1) for x in table["entries"].to_pylist()]
        both = np.concatenate(lists, axis=1)
        hashes, doc = both[0], both[1].view(np.int64)
        owner = np.repeat(np.arange(len(lists)), [x.shape[1] for x in lists])
        order = np.lexsort((doc, hashes))
        hashes, doc, owner = hashes[order], doc[order], owner[order]
        new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        least = np.repeat(doc[new], np.diff(np.r_[new, len(hashes)]))
        later = least < doc
        hashes, least, owner = hashes[later], least[later], owner[later]
        grps, order = table["grp"].to_pylist(), np.argsort(owner, kind="stable")
        return _table(PACK, [(bucket, grps[k], hashes[i].tobytes() + least[i].astype("<i8").tobytes()) for k, i in _dealt(owner, order, len(grps))])

    def remove(self, key: tuple, table: pa.Table, firsts: pa.Table) -> pa.Table:
        """The documents without the words of windows that a smaller document holds."""
        words = Words(table["text"])
        ids = table["doc_id"].to_numpy() if table.num_rows else np.zeros(0, np.int64)
        drop = np.zeros(len(words.starts), dtype=bool)
        hashes, whole = words.windows(self.window)
        n = len(hashes)
        if n:
            doc = ids[words.text_of_word()[:n]]
            order = np.lexsort((doc, hashes))
            new = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
            least = np.empty(n, dtype=np.int64)
            # Windows that span two texts are never counted: give them no document of their own.
            own = np.where(whole, doc, np.iinfo(np.int64).max)[order]
            least[order] = np.repeat(np.minimum.reduceat(own, new), np.diff(np.r_[new, n]))
            if firsts.num_rows:
                lists = [np.frombuffer(x, dtype="<u8").reshape(2, -1) for x in firsts["entries"].to_pylist()]
                both = np.concatenate(lists, axis=1)
                order = np.argsort(both[0])
                known, first = both[0][order], both[1].view(np.int64)[order]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                least = np.where(known[at] == hashes, np.minimum(least, first[at]), least)
            start = np.flatnonzero(whole & (least < doc))
            step = np.zeros(len(drop) + 1, dtype=np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + self.window, -1)
            drop = np.cumsum(step)[:-1] > 0
        rows, raw, at, first = [], words.raw, words.at, words.first
        for i in range(len(ids)):
            mine = drop[first[i] : first[i + 1]]
            kept = raw[at[i] : at[i + 1]].tobytes().split()
            if mine.any():
                kept = compress(kept, (~mine).tolist())
            rows.append((int(ids[i]), len(mine), int(mine.sum()), b" ".join(kept).decode()))
        return _table([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())], rows)


def dedup_substrings(docs: DataFrame, window: int = 13, block: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: kept is its remaining words, joined by one space."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plan = _Plan(window, block, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = docs.where("doc_id IS NOT NULL").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(plan.parts)).cast("int"))
    hits = (dealt.groupBy("grp").applyInArrow(lambda t: plan.send_anchors(t), ENTRIES)
            .groupBy("bucket").applyInArrow(lambda t: plan.match_anchors(t), ENTRIES))
    firsts = (dealt.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda k, t, h: plan.send_windows(k, t, h), ENTRIES)
              .groupBy("bucket").applyInArrow(lambda t: plan.match_windows(t), ENTRIES))
    kept = dealt.groupBy("grp").cogroup(firsts.groupBy("grp")).applyInArrow(lambda k, t, f: plan.remove(k, t, f), OUT)
    words = F.expr("filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")
    without_id = docs.where("doc_id IS NULL").select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("kept"))
    return kept.unionByName(without_id)
