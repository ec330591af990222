"""Elias-Fano coding of rising sequences, with access and successor search on whole arrays of queries.

A sequence of n values below u keeps the low l = log2(u / n) bits of each value packed one after another,
and the high parts in unary: value i sets bit (high + i). Both parts are arrays of 64-bit words, so a
sequence takes about 2 + l bits a value and can be read from memory-mapped files.
"""

from __future__ import annotations

import numpy as np

_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _NTH[b, k]: place of the k-th set bit of byte b.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _place in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _place


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after another in 64-bit words, one word more than needed."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width == 0 or not len(values):
        return words
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    values = values.astype(np.uint64)
    np.bitwise_or.at(words, word, values << shift)
    over = shift + np.uint64(width) > np.uint64(64)
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def unpacked(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A rising sequence; its arrays can be written out and mapped back."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.width, self.low, self.high, self.counts = n, width, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        width = min(60, max(1, bound // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(((n + (bound >> width) + 1) // 64 + 1) * 64, bool)
        bits[high + np.arange(n)] = True
        unary = np.packbits(bits, bitorder="little")
        counts = np.concatenate([[0], np.cumsum(_BITS[unary].reshape(-1, 8).sum(1))]).astype(np.int64)
        return cls(n, width, packed(values & np.uint64((1 << width) - 1), width), unary, counts)

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the bit number ``rank`` (from 0) among the ones or the zeros."""
        counts = self.counts if one else np.arange(len(self.counts), dtype=np.int64) * 64 - self.counts
        word = np.searchsorted(counts, rank, "right") - 1
        left = rank - counts[word]
        at = word * 8
        group = self.high[at[:, None] + np.arange(8)]
        if not one:
            group = ~group
        sums = np.cumsum(_BITS[group], axis=1, dtype=np.int64)
        byte = (sums <= left[:, None]).sum(1)
        rows = np.arange(len(rank))
        before = np.where(byte > 0, sums[rows, np.maximum(byte - 1, 0)], 0)
        return (at + byte) * 8 + _NTH[group[rows, byte], left - before]

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at ``index``."""
        high = self._select(index, True) - index
        return (high.astype(np.uint64) << np.uint64(self.width)) | unpacked(self.low, self.width, index)

    def _seek(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value not below each wanted one, and whether it has the same high part.

        Zeros end the buckets of equal high parts, so two of them bound the bucket of a wanted value, and a
        binary search over the bucket's low parts does the rest.
        """
        high = (wanted >> np.uint64(self.width)).astype(np.int64)
        low = wanted & np.uint64((1 << self.width) - 1)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self._select(high, False) - high
        left, right = first, end.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            below = unpacked(self.low, self.width, middle) < low[open_]
            left[open_] = np.where(below, middle + 1, left[open_])
            right[open_] = np.where(below, right[open_], middle)
            open_ = open_[left[open_] < right[open_]]
        return left, left < end

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value not below each wanted one (n if none), and that value."""
        index, _ = self._seek(wanted.astype(np.uint64))
        value = np.zeros(len(wanted), np.uint64)
        inside = np.flatnonzero(index < self.n)
        value[inside] = self.at(index[inside])
        return index, value

    def place(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, -1 where its successor is another value."""
        wanted = wanted.astype(np.uint64)
        index, same = self._seek(wanted)
        found = np.flatnonzero(same)
        equal = unpacked(self.low, self.width, index[found]) == wanted[found] & np.uint64((1 << self.width) - 1)
        out = np.full(len(wanted), -1)
        out[found[equal]] = index[found[equal]]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "counts": self.counts}
