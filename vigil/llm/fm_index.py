"""A full-text index: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet tree.

The wavelet tree has four branches a node, two bits of a symbol each, and is kept level by level (all nodes of a level
side by side, lower branches before higher ones). A level says, for each position and branch, where the symbols of that
branch before the position end up in the next level, so a rank is one look-up a level and many positions are looked up at
once. Backward search extends many patterns by one symbol in each step. Only the tree, the counts of smaller symbols and
the sums of weights are kept; text and suffix array are dropped.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (positive symbols) in order of their first `depth` symbols at least; an end mark sorts first.

    The first sort takes as many symbols as a key holds; later ones, of twice as many each, only the suffixes that are
    still among equals. A rank is the place where its equals begin.
    """
    n, bits = len(text), max(1, int(text.max(initial=0)).bit_length())
    k = max(1, min(62 // bits, depth))
    key = np.zeros(n + 1, np.int64)
    for i in range(k):
        key <<= bits
        key[: max(0, n - i)] |= text[i:]
    order = np.argsort(key)  # equal keys get equal ranks, so their order is free
    places, key = np.arange(n + 1), key[order]
    rank = np.zeros(n + 1, np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        places = places[~(new & np.append(new[1:], True))]
        if k >= depth or not len(places):
            return order
        at = order[places]
        key = rank[at] * (n + 2) + np.where(at + k <= n, rank[np.minimum(at + k, n)] + 1, 0)
        by = np.argsort(key)
        order[places], key = at[by], key[by]
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray | None = None):
        """text: symbols from 1 up; patterns of up to depth symbols can be searched for.

        weight: for each symbol, how many times the text that begins there stands in the collection (default: once).
        """
        order = suffix_array(text, depth)
        n = len(text)
        each = np.append(np.ones(n, np.int64) if weight is None else weight, 0)
        self.times = np.concatenate([[0], np.cumsum(each[order])])  # of the suffixes before each place
        bwt = np.where(order > 0, np.append(text, 0)[order - 1], 0).astype(np.int64)
        sigma = int(text.max(initial=0)) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))]).astype(np.int64)
        self.size = n + 1
        bwt = bwt.astype(np.int32)
        self.levels = []  # bits of a symbol below the level's two; 4 * position + branch: position in the next level
        for shift in reversed(range(0, max(1, int(sigma - 1).bit_length()), 2)):
            branch = (bwt >> shift) & 3
            parts = [branch == i for i in range(4)]
            table, begin = np.empty((n + 2, 4), np.int32), 0
            for i, part in enumerate(parts):
                table[0, i] = begin
                np.cumsum(part, out=table[1:, i])
                table[1:, i] += begin
                begin = int(table[-1, i])
            self.levels.append((shift, table.reshape(-1)))
            bwt = np.concatenate([bwt[part] for part in parts])
        # of each symbol: its place among sorted suffixes, less that of its first occurrence in the last level
        symbols = np.arange(sigma)
        self.base = self.smaller[:-1] - self._place(symbols, np.zeros(sigma, np.int64))

    def _place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before a position end up in the last level, if that symbol comes next."""
        for shift, table in self.levels:
            at = table[(at << 2) | (symbols >> shift) & 3]
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with a symbol put before each."""
        n, base = len(symbols), self.base[symbols]
        both = self._place(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return base + both[:n], base + both[n:]

    def reach(self, text: np.ndarray, end: np.ndarray, floor: np.ndarray, least: int = 2) -> np.ndarray:
        """The least s >= floor for which text[s : end + 1] occurs `least` times or more (by weight); end + 1 if there is none.

        These are the matching statistics of the places `end`, by backward search.
        """
        begin, alive = end + 1, np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        while len(alive):
            inside = begin[alive] > floor[alive]
            alive, low, high = alive[inside], low[inside], high[inside]
            low, high = self.extend(text[begin[alive] - 1], low, high)
            more = self.times[high] - self.times[low] >= least
            alive, low, high = alive[more], low[more], high[more]
            begin[alive] -= 1
        return begin

    def repeated_windows(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
        """Bit masks: bit i of a segment text[begin : begin + length] says that its window i occurs twice or more.

        From a segment's end, the longest repeated text is found; all windows in it are repeated, and the next end to
        look at is that of the window that begins just before it. If it is shorter than a window, the word before it
        is tried with a few of the following ones: windows that hold a unique text are skipped together.
        """
        mask = np.zeros(len(begin), np.int64)
        todo = np.flatnonzero(length >= window)
        end = begin + length - 1
        while len(todo):
            b, e = begin[todo], end[todo]
            s = self.reach(text, e, b)
            low, high = s - b, e - (window - 1) - b
            some = high >= low
            mask[todo[some]] |= (np.int64(1) << (high[some] + 1)) - (np.int64(1) << low[some])
            after = np.minimum(e - 1, s + window - 2)
            short = np.flatnonzero(~some & (s > b))
            for m in (0, 1, 3):
                short = short[s[short] - 1 + m < e[short]]
                odd = s[short] - 1
                unique = self.reach(text, odd + m, odd) > odd
                after[short[unique]] = odd[unique] + m - 1
                short = short[~unique]
            end[todo] = after
            todo = todo[after - (window - 1) >= b]
        return mask
