"""A compressed FM-index over integer symbols: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search.

Searches run for many patterns at once; a pattern is one row of NumPy arrays, so a step costs a few array operations per
bit of the alphabet whatever the number of patterns.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length; a suffix sorts before its extensions."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, length = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        if length < n:
            after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if new.max() == n - 1:
            return order
        rank, length = new, 2 * length


class Wavelet:
    """Rank of a symbol before a position; one bit vector per bit of the alphabet with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        row = symbols.astype(np.int64)
        for level in range(self.depth):
            bits = ((row >> (self.depth - 1 - level)) & 1).astype(bool)
            packed = np.zeros(-(-(len(bits) + 1) // 64) * 8, dtype=np.uint8)
            some = np.packbits(bits, bitorder="little")
            packed[: len(some)] = some
            words = packed.view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            row = np.concatenate((row[~bits], row[bits]))
        self.begin = self._descend(np.arange(size, dtype=np.int64), np.zeros(size, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            word = at >> 6
            below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][word] + np.bitwise_count(below)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.begin[symbol]


class FMIndex:
    """Of a text whose symbols lie in 0..size - 1."""

    def __init__(self, text: np.ndarray, size: int):
        self.n = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        # read cyclically the text has one row more than suffixes: a terminator below all symbols, placed by doubling
        order = suffix_order(text)
        shifted = np.concatenate(([self.n - 1], order - 1))
        self.row_of_end = 1 + int(np.flatnonzero(order == 0)[0])
        self.wavelet = Wavelet(np.where(shifted < 0, 0, text[shifted]), size)

    def _rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol in the transform before a row; the terminator's cell holds a stand-in for symbol 0."""
        return self.wavelet.rank(symbol, row) - ((symbol == 0) & (row > self.row_of_end))

    def everything(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(k, dtype=np.int64), np.full(k, self.n + 1, dtype=np.int64)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with `symbol` put before each; hi - lo is the number of places where a pattern occurs."""
        k = len(symbol)
        both = self._rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        start = 1 + self.before[symbol]
        return start + both[:k], start + both[k:]


def repeated_windows(index: FMIndex, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """Marks, aligned with `patterns`, the places where a window begins that occurs twice or more in the index.

    patterns holds the symbols of all patterns one after the other; every pattern is itself part of the indexed text, and stands for
    `weights` equal ones. From the right end each pattern is extended to the left as long as it occurs twice; what was reached is a
    matching statistic. A match of at least `window` symbols marks the windows in it, and the search goes on from the last end that a
    further window can have.
    """
    marks = np.zeros(len(patterns) + 1, dtype=np.int64)
    q = np.flatnonzero(lengths >= window)
    end = lengths[q].copy()
    at = end.copy()
    lo, hi = index.everything(len(q))
    while len(q):
        symbol = patterns[starts[q] + at - 1]
        new_lo, new_hi = index.extend(symbol, lo, hi)
        good = (new_hi - new_lo >= 2) | ((new_hi - new_lo == 1) & (weights[q] >= 2))
        at = np.where(good, at - 1, at)
        lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
        stop = ~good | (at == 0)
        if stop.any():
            long = stop & (end - at >= window)
            np.add.at(marks, starts[q[long]] + at[long], 1)
            np.add.at(marks, starts[q[long]] + end[long] - window + 1, -1)
            # windows left begin before `at`, so they end before at + window
            next_end = np.where(end - at >= window, at + window - 1, end - 1)
            end = np.where(stop, next_end, end)
            done = stop & (end < window)
            all_lo, all_hi = index.everything(len(q))
            lo, hi, at = np.where(stop, all_lo, lo), np.where(stop, all_hi, hi), np.where(stop, end, at)
            q, end, at, lo, hi = (x[~done] for x in (q, end, at, lo, hi))
    return np.cumsum(marks[:-1]) > 0
