"""A compressed full-text index over a sequence of symbols, in numpy, searched for many phrases at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit sequence with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Rank and access over symbols: one bit sequence for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (rest >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            rest = np.concatenate((rest[~ones], rest[ones]))
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: order by the first 1, 2, 4, ... symbols until no two are alike."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + 2 + n) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
        rank, step = new, step * 2
        if step >= n or int(rank.max()) == n - 1:
            return order


class FMIndex:
    """Burrows-Wheeler transform of ``text`` (symbols 1 .. size-1) with a wavelet tree and sampled suffix positions."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8) -> None:
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_order(text)
        self.n, self.size = len(text), size
        self.tree = WaveletTree(text[order - 1], size)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:size]
        sampled = order % sample == 0
        self.is_sampled, self.sampled_at = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases, one per row: the range of suffixes that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[:, k]
            low = self.less[symbol] + self.tree.rank(symbol, low)
            high = self.less[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back through the text until a sampled position is met."""
        found = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            known = self.is_sampled.get(at)
            found[open_[known]] = self.sampled_at[self.is_sampled.rank(at[known])] + steps
            open_, at = open_[~known], at[~known]
            if len(open_):
                symbol, before = self.tree.access(at)
                at, steps = self.less[symbol] + before, steps + 1
        return found % self.n
