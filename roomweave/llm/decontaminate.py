"""Benchmark passages in documents, by Wu-Manber search for many patterns.

Texts become words in lower case between single spaces, and every window of ``words`` words of a test item (an item of
fewer words as a whole) is a pattern with a space at either end, so that it is found at whole words only.  A table
tells for each block of bytes how far the search may move when it meets the block: to where the block occurs last
within the shortest pattern's length of any pattern.  Where it may not move, the block is a pattern's suffix there: its
bucket holds the patterns that end so, sorted, and the text is compared with those of them that it can begin with.
Lengths fall into classes with tables of their own, so that a short item does not shorten every step.

Cursors a kilobyte apart move through a slice of documents in step, each step a few array operations; Spark deals the
documents and nothing is shuffled.  The distinct patterns with their items are cut into shards of a bounded size, each
of which is broadcast; where there are several, the documents pass them in turn.

Null and empty texts have no words.  Words are runs of 0-9, a-z, and all above ASCII; A-Z are lowered.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomweave.llm.storage import checkpointed
from roomweave.llm.wordhash import slices, text_bytes

SHARD_BYTES = 8 << 20  # of patterns and item ids in a broadcast
AT_ONCE = 4  # shards that documents pass before they are written
CLASSES = (0, 8, 16, 32)  # least lengths in bytes
LONGEST = 512  # bytes of a pattern that the table knows
APART = 1024  # bytes between cursors
WINDOWS = "window binary, words int, item string"

_WORD = np.full(256, 0x20, dtype=np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 0x80:
        _WORD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _WORD[_b] = _b


class Normal:
    """Texts on end as bytes: each a zero byte, and its words with a space before, between and behind."""

    def __init__(self, column: pa.Array):
        raw, at = text_bytes(column)
        n = len(at) - 1
        wide = np.full(len(raw) + 3 * n, 0x20, dtype=np.uint8)
        wide[np.arange(len(raw)) + np.repeat(3 * np.arange(n) + 2, np.diff(at))] = _WORD[raw]
        wide[at[:-1] + 3 * np.arange(n)] = 0
        space = wide == 0x20
        again = np.zeros(len(wide), dtype=bool)
        again[1:] = space[1:] & space[:-1]
        self.data = wide[~again]
        word = (self.data != 0x20) & (self.data != 0)
        new = word.copy()
        new[1:] &= ~word[:-1]
        self.starts = np.flatnonzero(new)  # of words
        self.first = np.r_[np.searchsorted(self.starts, np.flatnonzero(self.data == 0)), len(self.starts)]  # word of each text, and their number

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _windows(batches, words: int):
    """A row for each window of each item."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts, items = Normal(part.column("text")), part.column("item").to_pylist()
            data, out = texts.data.tobytes(), []
            ends = np.r_[texts.starts[1:], 0] - 1  # of a word's space; the last of a text is set below
            last = texts.first[1:][texts.counts() > 0] - 1
            ends[last] = np.r_[np.flatnonzero(texts.data == 0)[1:], len(data)][texts.counts() > 0] - 1
            for k, item in enumerate(items):
                a, b = int(texts.first[k]), int(texts.first[k + 1])
                size = min(words, b - a)
                for i in range(a, b - size + 1 if size else a):
                    out.append((data[texts.starts[i] - 1 : ends[i + size - 1] + 1], size, item))
                    if len(out) >= 10_000:
                        yield _table(out)
                        out = []
            yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.string()))], names=["window", "words", "item"])


def windows(tests: DataFrame, words: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, words, item): the distinct patterns of each item, its id as a string."""
    rows = tests.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _windows(batches, words), WINDOWS).distinct()


class _Class:
    """Tables of the patterns of one class of lengths."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.m = min(LONGEST, min(map(len, patterns)))
        self.block = min(8, self.m)
        known = np.frombuffer(b"".join(p[: self.m] for p in patterns), dtype=np.uint8).reshape(len(patterns), self.m)
        places = self.m - self.block + 1
        self.bits = min(22, max(12, (4 * len(patterns) * places).bit_length()))
        self.shift = np.full(1 << self.bits, places, dtype=np.int16)
        for j in range(places):  # a later place asks for a smaller step
            codes = self.codes(known[:, j : j + self.block])
            self.shift[self.slot(codes)] = places - 1 - j
        self.suffixes, bucket = np.unique(codes, return_inverse=True)
        held: list[list[tuple[bytes, int]]] = [[] for _ in self.suffixes]
        for p, number, k in zip(patterns, numbers.tolist(), bucket.tolist()):
            held[k].append((p, number))
        self.buckets = [_bucket(sorted(x)) for x in held]

    def codes(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(blocks), 8), dtype=np.uint8)
        out[:, : self.block] = blocks
        return out.view("<u8")[:, 0]

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def occurrences(self, data: np.ndarray, plain: bytes) -> tuple[list[int], list[int]]:
        """Places and numbers of the patterns found."""
        starts, numbers = [], []
        if len(data) < self.m:
            return starts, numbers
        view = np.lib.stride_tricks.sliding_window_view(data, self.block)
        at = np.arange(self.m - 1, len(data), APART)  # where the part known of a pattern would end
        stop = np.minimum(at + APART, len(data))
        while len(at):
            codes = self.codes(view[at - self.block + 1])
            step = self.shift[self.slot(codes)]
            held = np.flatnonzero(step == 0)
            if len(held):
                k = np.minimum(np.searchsorted(self.suffixes, codes[held]), len(self.suffixes) - 1)
                same = self.suffixes[k] == codes[held]
                for end, bucket in zip(at[held][same].tolist(), k[same].tolist()):
                    start = end - self.m + 1
                    for number in _begins(plain, start, self.buckets[bucket]):
                        starts.append(start)
                        numbers.append(number)
            at = at + np.maximum(step, 1).astype(np.int64)
            live = at < stop
            at, stop = at[live], stop[live]
        return starts, numbers


def _bucket(held: list[tuple[bytes, int]]):
    """Sorted patterns, their numbers, for each the longest other that it begins with, and the longest length."""
    patterns, within, open_ = [p for p, _ in held], [], []
    for k, p in enumerate(patterns):
        while open_ and not p.startswith(patterns[open_[-1]]):
            open_.pop()
        within.append(open_[-1] if open_ else -1)
        open_.append(k)
    return patterns, [n for _, n in held], within, max(map(len, patterns))


def _begins(plain: bytes, start: int, bucket):
    """Numbers of the bucket's patterns that the text at start begins with: the greatest not above it, and those that this one begins with."""
    patterns, numbers, within, longest = bucket
    text = plain[start : start + longest]
    k = bisect_right(patterns, text) - 1
    while k >= 0:
        if text.startswith(patterns[k]):
            yield numbers[k]
        k = within[k]


class Patterns:
    """A shard of patterns with their items; tables are built once in a process."""

    def __init__(self, table: pa.Table):
        order = sorted(zip(table["window"].to_pylist(), table["words"].to_pylist(), table["item"].to_pylist()), key=lambda x: (x[0], x[2] is None, x[2] or ""))
        self.items = sorted({i for _, _, i in order if i is not None})
        place = {i: k for k, i in enumerate(self.items)}
        self.patterns, self.words, self.held, self.owners = [], [], [0], []
        for p, n, i in order:
            if not self.patterns or self.patterns[-1] != p:
                self.patterns.append(p)
                self.words.append(n)
                self.held.append(self.held[-1])
            if i is not None:
                self.owners.append(place[i])
                self.held[-1] += 1
        self._classes = None

    def classes(self) -> list[_Class]:
        if self._classes is None:
            kind = np.searchsorted(CLASSES, [len(p) for p in self.patterns], "right")
            self._classes = [_Class([self.patterns[i] for i in some], some) for k in range(len(CLASSES) + 1) if len(some := np.flatnonzero(kind == k))]
        return self._classes

    def find(self, texts: Normal) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word and word behind of each occurrence; texts and items that belong together, each pair once."""
        plain, starts, numbers = texts.data.tobytes(), [], []
        for c in self.classes():
            s, k = c.occurrences(texts.data, plain)
            starts += s
            numbers += k
        number = np.array(numbers, dtype=np.int64)
        first = np.searchsorted(texts.starts, np.array(starts, dtype=np.int64))
        text, number_of = _pairs(np.searchsorted(texts.first, first, "right") - 1, number, len(self.patterns))
        held = np.array(self.held, dtype=np.int64)
        size = held[number_of + 1] - held[number_of]
        at = np.repeat(held[number_of], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        owner = np.array(self.owners, dtype=np.int64)[at]
        return first, first + np.array(self.words, dtype=np.int64)[number], *_pairs(np.repeat(text, size), owner, len(self.items))


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, b below n, ascending."""
    both = np.unique(a * max(1, n) + b)
    return both // max(1, n), both % max(1, n)


def _lists(owner: np.ndarray, n: int) -> pa.Array:
    """Offsets of lists, for values in the order of their owners."""
    return pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))


def _scan(batches, shard):
    """Each batch with what the shard's patterns add to its spans and items, and its number of words."""
    for batch in batches:
        for part in slices(batch, "text"):
            found, texts, n = shard.value, Normal(part.column("text")), part.num_rows
            first, behind, text, item = found.find(texts)
            before = part.column("spans")
            flat, size = before.flatten(), before.value_lengths().to_numpy(zero_copy_only=False)
            base = np.repeat(texts.first[:-1], size)
            first = np.r_[first, flat.field("first").to_numpy() + base]
            behind = np.r_[behind, flat.field("behind").to_numpy() + base]
            change = np.zeros(len(texts.starts) + 1, dtype=np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, behind, -1)
            hit, owner = np.cumsum(change)[:-1] > 0, texts.text_of_word()
            edge = np.ones(len(hit) + 1, dtype=bool)  # a text's first word, and behind the last
            edge[1:-1] = owner[1:] != owner[:-1]
            begin = np.flatnonzero(hit & (edge[:-1] | ~np.r_[False, hit[:-1]]))
            end = np.flatnonzero(hit & (edge[1:] | ~np.r_[hit[1:], False])) + 1
            own = owner[begin]
            spans = pa.StructArray.from_arrays([pa.array((x - texts.first[own]).astype(np.int32)) for x in (begin, end)], names=["first", "behind"])
            held = part.column("items")
            names, owners = held.flatten().to_pylist() + [found.items[i] for i in item.tolist()], np.r_[np.repeat(np.arange(n), held.value_lengths().to_numpy(zero_copy_only=False)), text]
            order = np.argsort(owners, kind="stable")
            items = pa.ListArray.from_arrays(_lists(owners[order], n), pa.array([names[i] for i in order.tolist()], type=pa.string()))
            new = {"n_words": pa.array(texts.counts()), "spans": pa.ListArray.from_arrays(_lists(own, n), spans), "items": items}
            yield pa.record_batch([new.get(c, part.column(i)) for i, c in enumerate(part.schema.names)], names=part.schema.names)


def find_passages(docs: DataFrame, tests: DataFrame, words: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs in a struct ``row``, with n_words, n_hit, spans and items.

    spans: array<struct<first, behind>>, the stretches of hit words by number from 0, ascending and apart.  items: the
    ids of the tests with a window in the text, as strings, ascending.  Each row gives a row, also equal ones.  Items of
    equal text are all listed, and an id with several texts once; a test without an id hits words but is not listed.
    Tests without words have no windows; with no tests, or none with words, nothing is hit.
    """
    patterns = checkpointed(windows(tests, words, item_id, item_text))
    size = patterns.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 40)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    none = F.array().cast
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"),
                       none("array<struct<first:int,behind:int>>").alias("spans"), none("array<string>").alias("items"))
    schema = rows.schema
    for k in range(shards):
        some = patterns.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == k).toArrow()  # at most about shard_bytes
        shard = docs.sparkSession.sparkContext.broadcast(Patterns(some))
        rows = rows.mapInArrow(lambda batches, shard=shard: _scan(batches, shard), schema)
        if k % AT_ONCE == AT_ONCE - 1 and k + 1 < shards:
            rows = checkpointed(rows)
    return rows.select("row", "n_words", n_hit(F.col("spans")).alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.behind - s.first)
