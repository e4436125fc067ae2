"""A small FM-index over word numbers: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backwards."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with counts of ones before each 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def ones(self, to: np.ndarray) -> np.ndarray:
        """Ones before each position of ``to``."""
        block = to >> 6
        below = (np.uint64(1) << (to & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


def order_to(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` symbols at least (doubling)."""
    _, rank = np.unique(text, return_inverse=True)
    n, h = len(text), 1
    rank = rank.astype(np.int64) + 1
    while True:
        far = np.zeros(n, np.int64)
        far[: max(0, n - h)] = rank[h:]
        key = rank * (n + 2) + far
        order = np.argsort(key, kind="stable")
        if h * 2 >= depth:
            return order
        sorted_key = key[order]
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else rank
        h *= 2


class FMIndex:
    """Index of ``text`` (symbols from 1; 0 ends a passage) for patterns of at most ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols; intervals of shorter patterns need no more.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        order = order_to(text, depth)
        last = text[order - 1]
        counts = np.bincount(text, minlength=1)
        self.size = n
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, Bits, int]] = []
        rows = last.astype(np.int64)
        symbols = np.arange(len(counts))
        origin = np.zeros(len(counts), np.int64)
        for level in range(max(1, int(len(counts) - 1).bit_length()) - 1, -1, -1):
            bit = (rows >> level) & 1
            bits, zeros = Bits(bit), int(n - bit.sum())
            self.levels.append((level, bits, zeros))
            ones = bits.ones(origin)
            origin = np.where((symbols >> level) & 1, zeros + ones, origin - ones)
            rows = np.concatenate([rows[bit == 0], rows[bit == 1]])
        self.origin = origin

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that have ``symbol`` in front of those of [low, high)."""
        m = len(symbol)
        at = np.concatenate([low, high])
        both = np.concatenate([symbol, symbol])
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((both >> level) & 1, zeros + ones, at - ones)
        at += self.before[both] - self.origin[both]
        return at[:m], at[m:]

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """For each end (exclusive) in ``stream``, the longest run up to it, of ``most`` symbols at most, that stands at
        two places of the index at least. ``stream`` uses the index's symbols; its 0s are not matched."""
        length = np.zeros(len(ends), np.int64)
        lanes = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(most):
            at = ends[lanes] - step - 1
            symbol = np.where(at >= 0, stream[at], 0)
            low, high = self.step(symbol, low, high)
            good = (symbol > 0) & (high - low >= 2)
            lanes, low, high = lanes[good], low[good], high[good]
            length[lanes] = step + 1
            if not len(lanes):
                break
        return length
