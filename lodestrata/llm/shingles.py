"""Vectorised word and shingle hashing over whole Arrow batches (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_word = np.zeros(256, bool)
_word[0x30:0x3A] = _word[0x41:0x5B] = _word[0x61:0x7B] = True
_word[0x80:] = True
_fold = np.arange(256, dtype=np.uint64)
_fold[0x41:0x5B] += 32
_fold += 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.have = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = np.uint64(pow(self.base, len(self.have), 1 << 64))
            self.have = np.concatenate([self.have, self.have * step])
        return self.have[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one UTF-8 text, in order.

    Words are runs of ASCII letters and digits and of bytes above 0x7F, with A-Z
    folded to lower case.  A word's hash is a polynomial in its bytes, taken as a
    difference of prefix sums and shifted back to the word's start.
    """
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = _word[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = _fold[raw] * _up.upto(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    value = (sums[ends] - sums[starts]) * _down.upto(len(raw))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(raw: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted different hashes of the k-word shingles; a shorter text is one shingle."""
    h = word_hashes(raw)
    n = len(h)
    if n == 0:
        return h
    width = min(n, k)
    acc = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        acc = mix(acc + h[i : i + len(acc)]) + np.uint64(width)
    return np.unique(acc)


def texts_of(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text, without copies; null counts as empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if v else flat[:0] for a, b, v in zip(offsets[:-1], offsets[1:], valid)]


def minhash(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(set, i) -> the smallest 32-bit hash of a set's shingles under the i-th of ``count`` hash functions.

    Two sets agree at i with a probability equal to their Jaccard similarity.  No set may be empty.
    """
    draw = np.random.default_rng(7_919)
    factors = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    terms = draw.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    if sets:
        short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for i in range(count):
            out[:, i] = np.minimum.reduceat(short * factors[i] + terms[i], starts)
    return out
