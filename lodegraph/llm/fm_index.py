"""A compressed FM-index over sequences of whole numbers, in numpy, with many backward searches at once.

The sequences are concatenated with separators; the Burrows-Wheeler transform is kept as a wavelet matrix: one bit vector
for each bit of the alphabet, 64 bits to a word with a running count for each word, so a rank is two look-ups.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array by prefix doubling, up to `depth` symbols; separators make all suffixes differ before that."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= depth:
            return order


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        """weights: how often each sequence stands in the corpus; a count is the sum over the places found."""
        self.alphabet = np.unique(np.concatenate(sequences))
        k, sizes = len(sequences), np.array([len(s) for s in sequences])
        codes = [np.searchsorted(self.alphabet, s) + k for s in sequences]
        # Symbols below k are separators, one for each sequence.
        text = np.concatenate([x for i, c in enumerate(codes) for x in (c, [i])])
        self.codes, self.k = codes, k
        order = suffix_order(text, 2 * int(sizes.max()) + 2)
        bwt = np.maximum(text[order - 1] - k + 1, 0)  # separators are one symbol here: no pattern holds them
        n_symbols = len(self.alphabet) + 1
        counts = np.bincount(bwt, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(k), sizes + 1)[order]
        self.heavy = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner])])
        self.levels, now = [], bwt
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (now >> b & 1).astype(np.uint8)
            self.levels.append((b, Bits(bit)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.n = len(text)

    def _rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places before lo and hi that hold the symbol, both from where the symbol's own run starts."""
        base = np.zeros_like(lo)
        for b, bits in self.levels:
            one = symbol >> b & 1 == 1
            l1, h1, b1 = bits.ones(lo), bits.ones(hi), bits.ones(base)
            lo = np.where(one, bits.zeros + l1, lo - l1)
            hi = np.where(one, bits.zeros + h1, hi - h1)
            base = np.where(one, bits.zeros + b1, base - b1)
        return lo - base, hi - base

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that start with the symbol and then with what [lo, hi) starts with."""
        a, b = self._rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.heavy[hi] - self.heavy[lo]


def repeated_windows(sequences: list[np.ndarray], weights: np.ndarray, width: int, at_once: int = 50_000) -> list[np.ndarray]:
    """For each sequence, the starts of its windows of `width` symbols that stand in the corpus twice or more.

    Each sequence is searched backward from its end as far as what is matched stands twice.  Where that stops, at s, all windows
    from s on are repeated; the search goes on from the end of the last window that starts before s.
    """
    index = FMIndex(sequences, weights)
    size = np.array([len(s) for s in sequences])
    out: list[list] = [[] for _ in sequences]
    flat = np.concatenate(index.codes) - index.k + 1
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    for c in range(0, len(sequences), at_once):
        lane = np.arange(c, min(c + at_once, len(sequences)))
        lane = lane[size[lane] >= width]
        top = size[lane] - width  # the last window not yet decided
        at = size[lane].copy()  # what is matched begins here and ends where that window does
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
        while len(lane):
            lo2, hi2 = index.extend(flat[begin[lane] + at - 1], lo, hi)
            good = index.weight(lo2, hi2) >= 2
            at = np.where(good, at - 1, at)
            lo, hi = np.where(good, lo2, lo), np.where(good, hi2, hi)
            stop = ~good | (at == 0)
            if not stop.any():
                continue
            for i in np.flatnonzero(stop & (at <= top)):
                out[lane[i]].append((int(at[i]), int(top[i])))
            # Where not even one window was matched, the last one holds what failed.
            top = np.where(stop, np.where(at <= top, at - 1, top - 1), top)
            at = np.where(stop, top + width, at)
            lo, hi = np.where(stop, 0, lo), np.where(stop, index.n, hi)
            keep = ~stop | (top >= 0)
            lane, at, lo, hi, top = (x[keep] for x in (lane, at, lo, hi, top))
    return [np.unique(np.concatenate([np.arange(a, b + 1) for a, b in o])) if o else np.zeros(0, np.int64) for o in out]
