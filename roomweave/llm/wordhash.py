"""Vectorised 64-bit hashes of words and word windows of an Arrow string column.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, so UTF-8 text needs no decoding.  A word's hash is a
polynomial over its bytes modulo the prime 2**61 - 1, taken as a difference of prefix sums and then scrambled; it is
the same in every process.  Two different words of n bytes share a hash for at most n of the 2**61 bases.  Windows of a
few words sum their words' scrambled hashes modulo 2**64; two windows of 13 words or fewer share a hash with a
probability of 2**-51 a pair or less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME = (1 << 61) - 1
BASE = 0x1E3779B97F4A7C15
STEP, STEP_INVERSE = U(0xD1342543DE82EF95), U(pow(0xD1342543DE82EF95, -1, 1 << 64))
SPAN = 1 << 20  # bytes hashed at a time
_powers: dict[int, np.ndarray] = {}
_residues: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, from halves of 31 bits: 2**62 is 2 there, and 2**61 is 1."""
    low = U((1 << 31) - 1)
    a0, a1, b0, b1 = a & low, a >> U(31), b & low, b >> U(31)
    middle = a1 * b0 + a0 * b1
    return _reduced(U(2) * (a1 * b1) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def _residue(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo PRIME."""
    have = _residues.get(base, np.ones(1, dtype=U))
    while len(have) < n:
        have = np.concatenate([have, _times(have, np.full(len(have), pow(base, len(have), PRIME), dtype=U))])
    _residues[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and each text's start (one more than texts). Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def _span_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of (byte + 1) * BASE**place modulo PRIME of each span, places from the first byte; of at most SPAN bytes in all."""
    power, values = _residue(BASE, len(raw)), raw.astype(U) + U(1)
    low, high = np.zeros(len(raw) + 1, dtype=U), np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(values * (power & U(0xFFFFFFFF)), out=low[1:])
    np.cumsum(values * (power >> U(32)), out=high[1:])
    low, high = low[ends] - low[starts], high[ends] - high[starts]
    return _reduced((high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32)) + low)


def _long_sum(raw: np.ndarray) -> int:
    """The same of one span of any length."""
    total = 0
    for at in range(0, len(raw), SPAN):
        part = raw[at : at + SPAN]
        total += int(_span_sums(part, np.array([0]), np.array([len(part)]))[0]) * pow(BASE, at, PRIME)
    return total % PRIME


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end); spans are ascending and do not overlap."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > SPAN:  # one long span
            sums = np.array([_long_sum(raw[lo:hi])], dtype=U)
        else:
            sums = _times(_span_sums(raw[lo:hi], starts[i:j] - lo, ends[i:j] - lo), _residue(pow(BASE, -1, PRIME), hi - lo + 1)[starts[i:j] - lo])
        out[i:j] = mix(sums + (ends[i:j] - starts[i:j]).astype(U))
        i = j
    return out


class Words:
    """Words of all texts of a column: byte spans, hashes, and each text's first word."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        self.raw, self.at = text_bytes(column)
        if lower:
            self.raw = lower_ascii(self.raw)
        word = ~is_space(self.raw)
        first = np.zeros(len(word) + 1, dtype=bool)
        first[self.at[:-1]] = True
        before = np.empty(len(word), dtype=bool)
        before[:1] = False
        before[1:] = word[:-1]
        new = word & (~before | first[:-1])
        self.starts = np.flatnonzero(new)
        stop = np.zeros(len(word) + 1, dtype=bool)
        stop[1:] = word
        after = np.ones(len(word) + 1, dtype=bool)
        after[:-1] = ~word | first[:-1]
        self.ends = np.flatnonzero(stop & after)
        self.first = np.searchsorted(self.starts, self.at)  # of each text, and the number of words
        self.hashes = span_hashes(self.raw, self.starts, self.ends) if hashes else None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for every k consecutive words, and whether they lie in one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        return window_hashes(self.hashes, k), self.text_of_word()[:n] == self.text_of_word()[k - 1 :]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.empty(max(n, 0), dtype=U)
    for i in range(0, n, SPAN):
        part = hashes[i : i + SPAN + k - 1]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(part * _power(STEP, len(part)), out=sums[1:])
        m = len(part) - k + 1
        out[i : i + m] = mix((sums[k : k + m] - sums[:m]) * _power(STEP_INVERSE, m) + U(k))
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """The batch in runs of rows with at most about ``most`` bytes of text; a longer text is a run of its own."""
    array = batch.column(column)
    _, offsets, _ = array.buffers()
    wide = pa.types.is_large_string(array.type)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(at, int(at[i]) + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
