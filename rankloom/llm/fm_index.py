"""FM-index over a sequence of small integers, in numpy.

Suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet tree, backward
search of many patterns at once, positions from a sample of the suffix array.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions keep their place in the suffix order.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; a suffix sorts before its extensions.

    Prefix doubling. Only suffixes that still share their rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    starts = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    width = 1
    while True:
        # Places whose rank is shared: neither a start that is followed by a start, nor alone.
        shared = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(shared):
            return order
        at = order[shared]
        ahead = at + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[shared] = at
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        starts[shared] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, shared, 0))
        width *= 2


class WaveletTree:
    """Occurrences of a symbol before a place, and the symbol at a place.

    One bit vector per bit of the symbols, highest first; at each level the symbols lie
    sorted by the bits above. Counts of set bits are kept for every place.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(len(level) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, end = np.zeros_like(place), place
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[level], ((symbol >> b) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start = np.where(bit, self.zeros[level] + s, start - s)
            end = np.where(bit, self.zeros[level] + e, end - e)
        return end - start

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol, start, end = np.zeros_like(place), np.zeros_like(place), place
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[end + 1] > ones[end]
            symbol = symbol * 2 + bit
            s, e = ones[start], ones[end]
            start = np.where(bit, self.zeros[level] + s, start - s)
            end = np.where(bit, self.zeros[level] + e, end - e)
        return symbol, end - start


class FmIndex:
    """Index of a text of integers from 1 on; 0 may separate parts of the text."""

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64) + 1, 0)  # a single smallest end symbol
        order = suffix_order(text)
        self.n = len(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def _ahead(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, place)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in suffix order, from and to, of each row of equally long patterns."""
        alive, s, e = np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for column in patterns.T[::-1]:
            symbol = column[alive].astype(np.int64) + 1
            known = symbol + 1 < len(self.before)  # no larger symbol stands in the text
            alive, symbol = alive[known], symbol[known]
            s, e = self._ahead(symbol, s[known]), self._ahead(symbol, e[known])
            found = e > s
            alive, s, e = alive[found], s[found], e[found]
        start, end = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        start[alive], end[alive] = s, e
        return start, end

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text position of each place: step back to a sampled position and count the steps."""
        position = np.full(len(place), -1, np.int64)
        open_, at, steps = np.arange(len(place)), place.astype(np.int64), 0
        while len(open_):
            found = self.sampled[at] >= 0
            position[open_[found]] = self.sampled[at[found]] + steps
            open_, at = open_[~found], at[~found]
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return position
