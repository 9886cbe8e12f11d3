"""Periodic runs of words, by enumerating maximal pairs in a bottom-up tree of LCP intervals.

A text's suffixes by words are sorted (ranks double in length until no suffix ties with another), neighbours' longest
common prefixes follow from the ranks, and intervals of the sorted suffixes with a common prefix form a tree that is
walked from its leaves up.  Each interval keeps the places of its suffixes, all in order and again by the word to their
left.  Where children meet, two places of different children with different left words are a maximal pair: what they
share, l words, can be extended neither way.  If they are d <= l words apart, the stretch of l + d words from the
first has period d and no neighbour extends it, so these pairs are exactly the runs; a stretch is also found at
multiples of its smallest period, and the least distance of those with its two ends is the period.

The smaller child is looked up in the larger, within l of each of its places; stretches of places with the same word to
the left are passed over by their list, since no pair is among them.  So the pairs looked at are those reported.
Intervals without two such places near enough, or of one left word, are told apart by array operations before.

Texts are dealt by Spark and worked on in slices; nothing is shuffled.  Words are runs outside 0x20 and 0x09-0x0D,
compared by 64-bit hashes.  Null and empty texts have no words and no runs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.llm.wordhash import Words, slices


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks of sorted keys: the place of the first that is equal."""
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


class Suffixes:
    """The suffixes of texts (arrays of numbered words on end) with at least ``least`` words shared with a neighbour.

    levels[k]: a rank for each place, equal for places of one text with 2**k words in common.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        self.levels = [_dense(order, np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool))]
        end = np.searchsorted(text, text, "right")  # place behind each place's text
        tied, reach = self._tied(order), 1
        while len(tied):
            rank = self.levels[-1]
            further = tied + reach
            # Beyond its text's end every place differs from every other.
            after = np.where(further < end[tied], rank[np.minimum(further, n - 1)].astype(np.int64) + 1, -1 - tied)
            order_tied = np.lexsort((after, rank[tied]))
            tied, after = tied[order_tied], after[order_tied]
            base = rank[tied]
            fresh = np.r_[True, base[1:] != base[:-1]]
            new = fresh | np.r_[True, after[1:] != after[:-1]]
            at = np.arange(len(tied))
            # A group of equal rank keeps its first place among all; its parts follow in order.
            ranked = rank.copy()
            ranked[tied] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
            self.levels.append(ranked)
            size = np.diff(np.r_[np.flatnonzero(new), len(tied)])
            tied = tied[np.repeat(size > 1, size)]
            reach *= 2

    def _tied(self, order: np.ndarray) -> np.ndarray:
        rank = self.levels[0][order]
        same = rank[1:] == rank[:-1]
        return order[np.r_[False, same] | np.r_[same, False]] if len(order) else order

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words places a and b have in common, different places of one text."""
        n, length = len(self.levels[0]), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + length, b + length
            same = (x < n) & (y < n)
            same &= self.levels[k][np.minimum(x, n - 1)] == self.levels[k][np.minimum(y, n - 1)]
            length += same << k
        return length

    def groups(self, least: int):
        """Places in order of their suffixes, those that share least words or more with a neighbour, and what each shares with the one before (0 at the start of a group)."""
        order = np.argsort(self.levels[-1], kind="stable")
        level = min(len(self.levels) - 1, least.bit_length() - 1)
        coarse = self.levels[level][order]
        near = np.flatnonzero(coarse[1:] == coarse[:-1]) + 1  # share 2**level at least
        length = np.zeros(len(order) + 1, dtype=np.int64)
        length[near] = self.shared(order[near - 1], order[near])
        length[length < least] = 0
        held = (length[:-1] > 0) | (length[1:] > 0)
        return order[held], length[:-1][held]


class _Places:
    """Places of an interval: all in order, and by the word to the left."""

    __slots__ = ("all", "left")

    def __init__(self, place: int, left: int):
        self.all, self.left = [place], {left: [place]}

    def others(self, lo: int, hi: int, left: int):
        """Places from lo to hi with another word to the left; runs of places with this word are passed over."""
        places, same = self.all, self.left.get(left, ())
        i, stop = bisect_left(places, lo), bisect_right(places, hi)
        j = bisect_left(same, lo)
        while i < stop:
            if j < len(same) and same[j] == places[i]:
                # The run goes on as long as the same steps in both lists lead to one place.
                step = 1
                while i + step < stop and j + step < len(same) and same[j + step] == places[i + step]:
                    step *= 2
                low, high = step // 2, min(step, stop - i, len(same) - j)
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if same[j + mid] == places[i + mid] else (low, mid)
                i, j = i + low + 1, j + low + 1
            else:
                yield places[i]
                i += 1

    def take(self, other: _Places) -> None:
        for p in other.all:
            insort(self.all, p)
        for left, places in other.left.items():
            mine = self.left.get(left)
            if mine is None:
                self.left[left] = places
            else:
                for p in places:
                    insort(mine, p)


def _pairs(places: list[int], lengths: list[int], left: list[int], least: int, repeats: int):
    """(place, words in common, distance) of maximal pairs in a group, distance * (repeats - 1) <= words in common."""

    def meet(a: _Places, b: _Places, length: int) -> _Places:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        reach = length // (repeats - 1)
        for word, some in small.left.items():
            for p in some:
                for o in large.others(p - reach, p + reach, word):
                    if length + abs(o - p) >= least:
                        found.append((min(o, p), length, abs(o - p)))
        large.take(small)
        return large

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Places]] = []  # lengths ascend; the places of an interval that is still open
    current = _Places(places[0], left[0])
    for place, length, word in zip(places[1:], lengths[1:], left[1:]):
        while stack and stack[-1][0] > length:
            inner, below = stack.pop()
            current = meet(below, current, inner)
        if stack and stack[-1][0] == length:
            current = meet(stack.pop()[1], current, length)
        stack.append((length, current))
        current = _Places(place, word)
    while stack:
        inner, below = stack.pop()
        current = meet(below, current, inner)
    return found


def _near_enough(places: np.ndarray, lengths: np.ndarray, left: np.ndarray, repeats: int) -> list[tuple[int, int]]:
    """Bounds of the groups with two places of different left words near enough to be a pair."""
    start = np.flatnonzero(lengths == 0)
    size = np.diff(np.r_[start, len(places)])
    group = np.repeat(np.arange(len(start)), size)
    most = np.maximum.reduceat(lengths, start)
    order = np.lexsort((places, group))
    gap = np.full(len(places), np.iinfo(np.int64).max)
    same = group[order][1:] == group[order][:-1]
    gap[1:][same] = np.diff(places[order])[same]
    near = np.minimum.reduceat(gap, start) <= most // (repeats - 1)
    mixed = np.minimum.reduceat(left, start) != np.maximum.reduceat(left, start)
    return [(a, a + n) for a, n in zip(start[near & mixed].tolist(), size[near & mixed].tolist())]


def runs_of(words: np.ndarray, text: np.ndarray, least: int = 12, repeats: int = 2) -> np.ndarray:
    """(start, length, period) of all runs, ascending, for numbered words of texts on end; starts count from the first text's first word."""
    shared = -(-least * (repeats - 1) // repeats)  # of a stretch of l + d >= least words with d <= l
    places, lengths = Suffixes(words, text).groups(shared)
    if not len(places):
        return np.zeros((0, 3), dtype=np.int64)
    first = np.r_[True, text[1:] != text[:-1]]
    left = np.where(first, -1 - np.arange(len(words)), np.r_[0, words[:-1]])[places]  # nothing stands before a text
    found: list[tuple[int, int, int]] = []
    for a, b in _near_enough(places, lengths, left, repeats):
        found += _pairs(places[a:b].tolist(), lengths[a:b].tolist(), left[a:b].tolist(), least, repeats)
    period: dict[tuple[int, int], int] = {}
    for place, length, apart in found:
        key = (place, length + apart)
        period[key] = min(apart, period.get(key, apart))
    return np.array(sorted((s, n, p) for (s, n), p in period.items()), dtype=np.int64).reshape(-1, 3)


def _scan(batches, least: int, repeats: int):
    for batch in batches:
        for part in slices(batch, "text"):
            words, n = Words(part.column("text")), part.num_rows
            owner, number = words.text_of_word(), np.unique(words.hashes, return_inverse=True)[1]
            runs = runs_of(number.astype(np.int64), owner, least, repeats)
            start, length, period = runs.T
            text = owner[start]
            change = np.zeros(len(owner) + 1, dtype=np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            drop = np.cumsum(change)[:-1] > 0
            dropped = np.r_[0, np.cumsum(drop)][words.first]
            kept = []
            for i in range(n):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = words.raw[words.at[i] : words.at[i + 1]].tobytes().split()
                if dropped[i + 1] > dropped[i]:
                    own = [w for w, gone in zip(own, drop[a:b].tolist()) if not gone]
                kept.append(b" ".join(own))
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start - words.first[text], length, period)], names=["start", "length", "period"])
            offsets = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            yield pa.record_batch([part.column("row"), pa.array(words.counts()), pa.ListArray.from_arrays(offsets, each), pa.array(kept, type=pa.binary()).cast(pa.string())],
                                  names=["row", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = 12, repeats: int = 2, text: str = "text") -> DataFrame:
    """All columns of docs in a struct ``row``, with n_words, runs and collapsed.

    runs: array<struct<start, length, period>>, ascending by start, then length: stretches of ``least`` words or more in
    which words a smallest period apart are the same, at least ``repeats`` (2 or more) periods long, and which no
    neighbour extends.  collapsed: the words in none of the runs behind its first period, joined by one space.
    Each row gives a row, also equal ones; a null or empty text has no runs and an empty text.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,length:long,period:long>>").alias("runs"), F.lit("").alias("collapsed")).schema
    return rows.mapInArrow(lambda batches: _scan(batches, least, repeats), schema)
