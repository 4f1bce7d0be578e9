"""Minimal perfect hash of distinct 128-bit keys, built and probed by numpy.

Level by level the keys that are left are dealt into a bitmap of twice their number; a key alone on its bit is placed
there, the others go on to the next level.  The number of a key is the number of set bits before its own, over all
levels: each of 0 .. n - 1 is taken once.  A little under four bits a key, and no key is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPREAD = 2  # bits of a level per key


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit generator: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mixed(high.view(np.uint64) ^ mixed(low.view(np.uint64) + step)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """sizes: bits of each level; words: the bitmaps one after the other; before: set bits before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, sizes, words: bytes) -> PerfectHash:
        words = np.frombuffer(words, np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(np.asarray(sizes, np.int64), words, np.cumsum(ones) - ones)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key; for a key it was not built from any number, or -1."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        start = 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = spot(high[left], low[left], level, size) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[word] + np.bitwise_count(below))[here]
            left, start = left[~here], start + size
        return out


def build(high: np.ndarray, low: np.ndarray) -> PerfectHash:
    """high, low: the halves of distinct keys, as signed 64-bit numbers."""
    sizes, words = [], [np.zeros(0, np.uint64)]
    while len(high):
        size = -(-SPREAD * len(high) // 64) * 64
        at = spot(high, low, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        high, low = high[~alone[at]], low[~alone[at]]
    return PerfectHash.of(sizes, np.concatenate(words).tobytes())
