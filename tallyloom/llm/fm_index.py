"""A compressed FM-index over sequences of numbers, built and searched in numpy.

The sequences stand one after another, each ended by a terminator of its own
that sorts below every number.  The Burrows-Wheeler transform is held in a
wavelet tree whose levels are bit vectors of 64-bit words with running counts
(the pointerless layout, in which zeros move to the left of every level).  All
patterns of a batch take each backward step together.
"""

from __future__ import annotations

import numpy as np

#: Patterns that take their steps together.
BATCH = 1 << 16


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    def __init__(self, values: np.ndarray, largest: int):
        self.height = max(1, int(largest).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.height - 1, -1, -1):
            bit = (values >> k) & 1
            self.levels.append(_Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def descend(self, value: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where each place lies at the bottom level on the path of its value."""
        out = list(places)
        for k, bits, zeros in zip(range(self.height - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = ((value >> k) & 1).astype(bool)
            for j, place in enumerate(out):
                ones = bits.rank(place)
                out[j] = np.where(one, zeros + ones, place - ones)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; text: ranks, those of the terminators unlike any other."""
    n, rank, k = len(text), text.astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """values: numbers from 1 of all sequences; lengths: of each sequence."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        count, self.largest = len(lengths), int(values.max(initial=0))
        ends = np.cumsum(lengths + 1) - 1
        self.n = len(values) + count
        text = np.zeros(self.n, np.int64)
        inside = np.ones(self.n, bool)
        inside[ends] = False
        text[inside] = values
        ranked = text + count - 1
        ranked[ends] = np.arange(count)
        order = suffix_array(ranked)
        #: The sequence that each suffix, in order, begins in.
        self.sequence = (np.searchsorted(ends, order)).astype(np.int32)
        self.tree = WaveletTree(text[order - 1], self.largest)
        every = np.arange(self.largest + 1)
        smaller = np.cumsum(np.bincount(text, minlength=self.largest + 1)) - np.bincount(text, minlength=self.largest + 1)
        (bottom,) = self.tree.descend(every, np.zeros(len(every), np.int64))
        self.shift = smaller - bottom
        #: Where the suffixes that begin with each number start.
        self.first = np.append(smaller, self.n)

    def backward(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the ends of the patterns (rows): how many of the last numbers match at most, and the interval of suffixes that begin with them."""
        rows, width = patterns.shape
        length, low, high = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.full(rows, self.n, np.int64)
        for i in range(0, rows, BATCH):
            part = patterns[i : i + BATCH]
            live = np.arange(len(part))
            a, b = low[i : i + BATCH], high[i : i + BATCH]
            for t in range(width - 1, -1, -1):
                value = part[live, t]
                known = (value >= 1) & (value <= self.largest)
                live, value = live[known], value[known]
                if t == width - 1:  # nothing matched yet: all suffixes of the number
                    x, y, shift = self.first[value], self.first[value + 1], 0
                else:
                    x, y = self.tree.descend(value, a[live], b[live])
                    shift = self.shift[value]
                x, y, some = x + shift, y + shift, y > x
                live, x, y = live[some], x[some], y[some]
                a[live], b[live] = x, y
                length[i + live] += 1
        return length, low, high
