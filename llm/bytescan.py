"""Vectorised views of a batch of texts: bytes, word bounds and rolling fingerprints.

A batch is one uint8 buffer with the offsets of its texts, as Arrow holds it, so a task works on whole
columns of texts with numpy and never loops over bytes or words.  Fingerprints are polynomials modulo 2**64
over a fixed random table of byte values, finished with a bit mixer.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
UNBASE = U(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets (one more than texts) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_powers: dict[int, np.ndarray] = {}


def trim() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and stages, their buffers needn't."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries have it
        pass


#: What a worker keeps between tasks, and how to drop it.
kept = {"powers": _powers.clear}


def forget(but: str = "") -> None:
    """Drop what other stages left in this worker; all but the one that is named."""
    for name, drop in kept.items():
        if name != but:
            drop()
    trim()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept up to 8 M of them."""
    have = _powers.get(int(base), np.ones(1, np.uint64))
    if len(have) < n:
        out = np.ones(max(n, 1 << 16), dtype=np.uint64)
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U(pow(int(base), done, 1 << 64))
            done += step
        have = out
        if len(out) <= 8 << 20:
            _powers[int(base)] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser known from public hash functions)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Rolling:
    """Fingerprints of any stretch of a buffer from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(TABLE[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(UNBASE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word (run of bytes other than blank, tab to carriage return)."""
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the word shingles of every text, their text numbers, and words per text.

    A text with words, but fewer than size, has one shingle of all its words.  data must be lower-cased before.
    """
    n = len(offsets) - 1
    start, end, text = word_bounds(data, offsets)
    words = np.bincount(text, minlength=n).astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    value = mix(Rolling(data).of(start, end) + (end - start).astype(np.uint64))
    few = np.flatnonzero((words > 0) & (words < size))
    begins = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(max(len(value) - size + 1, 0), np.uint64)
    for k in range(size):
        out = mix(out * BASE + value[k : k + len(out)])
    whole = text[: len(out)] == text[size - 1 :][: len(out)] if len(out) else np.zeros(0, bool)
    short = np.array([_sequence(value[begins[t] : begins[t + 1]]) for t in few], dtype=np.uint64)
    return np.concatenate([out[whole], short]), np.concatenate([text[: len(out)][whole], few]), words


def _sequence(values: np.ndarray) -> np.uint64:
    h = np.array([len(values)], dtype=np.uint64)
    for v in values:
        h = mix(h * BASE + v)
    return h[0]


def pack_keys(keys: np.ndarray, size: int) -> bytes:
    """The leading size bytes of each key, byte by byte of all keys: the first bytes of sorted keys compress well."""
    cut = (keys >> np.uint64(8 * (8 - size))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return np.ascontiguousarray(cut.T[::-1]).tobytes()


def unpack_keys(blob: bytes, size: int) -> np.ndarray:
    """The keys of pack_keys, shifted down to their leading bytes."""
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(size, -1)[::-1].T
    return out.reshape(-1).view("<u8")
