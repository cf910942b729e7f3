"""SetSketch registers of word-shingle sets.

Every element draws an increasing sequence of exponential values, the j-th
from the j-th of m disjoint intervals, each for another register; a register
keeps the least value it is given. As the intervals ascend, a register is
settled by the first round that reaches it, so a set of n elements costs about
n + m log m steps. A value x is stored as floor(1 - log_b(rate x)), truncated
to 16 bits. Registers of a union are the larger ones, and equal registers tell
similar sets, so they can be banded.
"""

from __future__ import annotations

import numpy as np
import xxhash

REGISTERS = 128
BASE = 1.001
RATE = 20.0
WORD_ENTRIES = 300_000
_TOP = 65535


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _WordHash()


def forget() -> None:
    _words.clear()


_PLACES = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct shingles of size words as sorted 64-bit hashes. A-Z are lower-cased; fewer words are one shingle."""
    words = text.encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += mix(hashes[i : n - width + 1 + i] * _PLACES[i % 6] + np.uint64(i)) * _PLACES[(i + 1) % 6]
    return np.unique(mix(total))


def fingerprint(elements: np.ndarray) -> bytes:
    """Of a whole set: two independent sums of 64 bits, and its size."""
    sums = [mix(np.array([mix(elements ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(elements))]))[0] for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.array([*sums, len(elements)], dtype="<u8").tobytes()


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """m registers (a power of two) of a set of hashes; zeros for an empty set."""
    if not len(elements):
        return np.zeros(m, np.uint16)
    start, stride = elements & np.uint64(m - 1), (elements >> np.uint64(32)) | np.uint64(1)
    best = np.zeros(m)  # exp(-x), whose largest is the least x
    rounds = np.arange(m) if len(elements) * m <= 8192 else None
    if rounds is not None:
        j = rounds[:, None].astype(np.uint64)
        at = ((start + j * stride) & np.uint64(m - 1)).astype(np.intp)
        np.maximum.at(best, at.ravel(), ((m - rounds[:, None] - _uniform(elements, j)) / m).ravel())
    else:
        for j in range(m):
            at = ((start + np.uint64(j) * stride) & np.uint64(m - 1)).astype(np.intp)
            value = (m - j - _uniform(elements, np.array([j], dtype=np.uint64))) / m
            fresh = best[at] < (m - j) / m if j else slice(None)
            np.maximum.at(best, at[fresh], value[fresh])
            if best.all():
                break
    x = -np.log(np.minimum(best, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, _TOP).astype(np.uint16)


def _uniform(elements: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each element and round; j is an array that broadcasts with the elements."""
    return ((mix(elements + (j + np.uint64(1)) * _PLACES[0]) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Jaccard similarity of each pair of rows of registers, of greatest joint likelihood given the set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(a)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(_share(u - v * j), 1e-12), np.maximum(_share(v - u * j), 1e-12)
        return above * np.log(p) + below * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    golden = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        left, right = high - golden * (high - low), low + golden * (high - low)
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2
