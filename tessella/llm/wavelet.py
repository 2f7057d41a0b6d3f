"""A wavelet matrix over small integer classes: rank and select in a few array steps a level, for many queries at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)  # one word more than is full: rank at the end needs no case of its own
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i places."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def place(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero."""
        counts = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(counts, k, "right") - 1
        own = self.words[word] if bit else ~self.words[word]
        inside = np.cumsum(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.int64)
        return word * 64 + (inside <= (k - counts[word])[:, None]).sum(1)


class WaveletMatrix:
    """classes: an array of integers from 0 to 2^bits - 1. A level holds one bit of each, from the highest on; the level
    below holds those with bit 0 first, then those with bit 1, each in the order above."""

    def __init__(self, classes: np.ndarray, bits: int):
        self.n, self.bits = len(classes), bits
        self.levels: list[tuple[Bits, int]] = []
        for k in reversed(range(bits)):
            one = (classes >> k & 1).astype(bool)
            self.levels.append((Bits(one), int(self.n - np.count_nonzero(one))))
            classes = np.concatenate([classes[~one], classes[one]])

    def _down(self, c: int, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in zip(reversed(range(self.bits)), self.levels):
            ones = bits.ones(i)
            i = zeros + ones if c >> k & 1 else i - ones
        return i

    def rank(self, c: int, i: np.ndarray) -> np.ndarray:
        """How often class c stands in the first i places."""
        return self._down(c, np.asarray(i, np.int64)) - self._down(c, np.zeros(1, np.int64))

    def select(self, c: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) entry of class c; there must be one."""
        i = self._down(c, np.zeros(1, np.int64)) + np.asarray(k, np.int64)
        for level in reversed(range(self.bits)):
            bits, zeros = self.levels[level]
            one = c >> (self.bits - 1 - level) & 1
            i = bits.place(i - zeros if one else i, one)
        return i

    def rank_all(self, classes: tuple[int, ...], i: np.ndarray) -> np.ndarray:
        """Entries of any of the classes in the first i places."""
        return sum(self.rank(c, i) for c in classes)

    def select_all(self, classes: tuple[int, ...], k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) entry of any of the classes: select for one class, else bisection on the sum of ranks."""
        if len(classes) == 1:
            return self.select(classes[0], k)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.rank_all(classes, middle) > k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low - 1
