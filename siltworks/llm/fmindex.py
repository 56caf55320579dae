"""An FM-index over a shard of word symbols, in numpy: suffix array, wavelet matrix, backward search of many phrases at once.

Symbol 0 stands for every word that no phrase has; such a word (and each text's end) sorts by its position, so no comparison
of suffixes runs past it and identical texts cost little. Every `sample`-th position of the suffix array is kept; the others
are found by walking backwards. All phrases of a set have one length and are searched together, dropping those that vanish.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; symbol 0 at position i counts as a symbol of its own, ranked by i, below all others."""
    n = len(symbols)
    zeros = symbols == 0
    n_zero = int(zeros.sum())
    rank = symbols.astype(np.int64) + n_zero
    rank[zeros] = np.arange(n_zero)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    # ranks as first positions of the groups, so that they stay valid while only open groups are sorted on
    first = np.ones(n, bool)
    first[1:] = sorted_rank[1:] != sorted_rank[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    size = np.diff(np.append(np.flatnonzero(first), n))
    open_at = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(open_at):
        suffix = order[open_at]
        follow = suffix + step
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.lexsort((key, group))
        suffix, key, group = suffix[by], key[by], group[by]
        order[open_at] = suffix
        first = np.ones(len(suffix), bool)
        first[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        start = open_at[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        rank[suffix] = start
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        open_at = open_at[np.repeat(size > 1, size)]
        step *= 2
    return order


class BitRank:
    """A bit vector with rank in constant time: packed words and a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = n - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol of a sequence, one bit vector for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(bool)
            self.levels.append(BitRank(bit))
            now = np.concatenate([now[~bit], now[bit]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            up = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(up, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, at) - self.begin[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            up = level.get(at).astype(np.int64)
            ones = level.ones(at)
            at = np.where(up == 1, level.zeros + ones, at - ones)
            symbol = symbol * 2 + up
        return symbol, at - self.begin[symbol]


class FMIndex:
    """symbols: ints in [0, sigma), 0 being any word that is not searched for; it must end with 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        assert symbols[-1] == 0
        order = suffix_array(symbols)
        self.sigma, self.sample = sigma, sample
        self.last = WaveletMatrix(symbols[order - 1].astype(np.int32), sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # a walk never steps over symbol 0: the position after one is kept as well
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.kept = BitRank(kept)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of `phrases`; returns the rows that occur and their ranges of suffixes."""
        there = np.diff(self.below) > 0
        there[0] = False
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1]):  # those with a symbol that the text lacks are dropped
            alive = alive[there[phrases[alive, k]]]
        if not len(alive):
            return alive, alive, alive
        low, high = self.below[phrases[alive, -1]], self.below[phrases[alive, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            ok = low < high
            alive, low, high = alive[ok], low[ok], high[ok]
            symbol = phrases[alive, k]
            base = self.below[symbol]
            low, high = base + self.last.rank(symbol, low), base + self.last.rank(symbol, high)
        ok = low < high
        return alive[ok], low[ok], high[ok]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of all suffixes in the ranges, with the number of the range of each."""
        sizes = high - low
        edges = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(low)), sizes)
        row = np.repeat(low - edges, sizes) + np.arange(int(sizes.sum()))
        result = np.zeros(len(row), np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            hit = self.kept.get(row[todo]) == 1
            done = todo[hit]
            result[done] = self.positions[self.kept.ones(row[done])] + steps
            todo = todo[~hit]
            symbol, before = self.last.access_rank(row[todo])
            row[todo] = self.below[symbol] + before
            steps += 1
        return result, owner
