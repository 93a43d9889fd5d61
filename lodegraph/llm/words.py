"""Words of a text as 64-bit hashes, and hashes of runs of words, in numpy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D.  Two runs of words count as equal if their 64-bit
hashes are; for a given pair that errs once in 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for the places of a shingle, and the base of rolling hashes.
PLACES = np.array([xxhash.xxh64_intdigest(bytes([i]), 11) | 1 for i in range(64)], dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word -> hash, with at most `entries` kept."""

    def __init__(self, entries: int = 100_000):
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.entries:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_known = Hashes()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() cuts at exactly these six bytes, and bytes.lower() changes A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words at every place."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    h = w[: len(w) - n + 1] * PLACES[0]
    for i in range(1, n):
        h += w[i : len(w) - n + 1 + i] * PLACES[i]
    return mix(h)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The set of n-word shingles, lower-cased and sorted; the whole sequence if there are fewer words."""
    w = hashes(split(text, lower=True))
    if 0 < len(w) < n:
        return mix((w * PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    return np.unique(runs(w, n))
