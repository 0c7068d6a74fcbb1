"""A full-text index in minute space over a sequence of symbols: wavelet-matrix ranks and sampled positions.

Symbol 0 separates runs. Phrases hold no 0, so none is found across a separator.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes, by prefix doubling.

    Separators count as different symbols, smaller than all others and ordered by place; the number
    of rounds is the logarithm of the longest repeated stretch between separators.
    """
    n = len(symbols)
    gap = symbols == 0
    rank = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + int(gap.sum()))
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (int(follow.max(initial=0)) + 1) + follow
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) if n else 0
        rank = fresh
        width *= 2
        if not n or rank[order[-1]] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """Rank and access over a symbol sequence, all queries of an array at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        now = symbols
        starts = np.zeros(sigma, np.int64)
        known = np.arange(sigma)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zero = len(now) - int(ones[-1])
            self.bits.append(bit.astype(bool))
            self.ones.append(ones)
            self.zeros.append(zero)
            now = np.concatenate((now[bit == 0], now[bit == 1]))
            starts = np.where((known >> level) & 1, zero + ones[starts], starts - ones[starts])
        self.starts = starts

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        at = end
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at - self.starts[symbol]


class FmIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        """``symbols`` begins with a separator; every ``sample``-th position and each start of a run is kept."""
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1].astype(np.int64), sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))[:-1]
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept = kept
        self.positions = order[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (a row each): the half-open range of suffixes of each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: the number of the phrase and the position in the text."""
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.arange(int(count.sum())) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        position = np.zeros(len(row), np.int64)
        open_ = np.arange(len(row))
        walked = 0
        while len(open_):
            at = row[open_]
            found = self.kept[at]
            position[open_[found]] = self.positions[self.kept_before[at[found]]] + walked
            open_ = open_[~found]
            symbol, rank = self.wavelet.access(row[open_])
            row[open_] = self.before[symbol] + rank
            walked += 1
        return phrase, position
