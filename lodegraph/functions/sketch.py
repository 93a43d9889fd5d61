"""Fingerprints and hash embeddings of texts, as pandas functions over Arrow batches.

Three tokenizers differ on purpose: retrieval_tokens keeps words of two bytes or more, fingerprint_tokens keeps all, and
hash_embed skips words of one byte itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cache, lru_cache
from itertools import islice
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the fingerprint and embedding formats.
DIMENSIONS, MAX_TOKENS, SALTS = 384, 512, 128
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


class Hashed:
    """Words of one task by number, each hashed once: 64 signs for SimHash and 128 salted values for MinHash.

    keep bounds the words held (about 600 bytes each); beyond it the half of them at most that most texts had stays, but for
    words of one text alone.  salts=0 leaves MinHash out.
    """

    def __init__(self, salts: int = SALTS, keep: int = 250_000, chunk: int = 20_000) -> None:
        self.keep, self.chunk, self.salted = keep, chunk, [s.to_bytes(4, "little") for s in range(salts)]
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.signs, self.mins = np.empty((1024, 64), np.int8), np.empty((1024, len(self.salted)), "<u4")
        self.met = np.zeros(1024, np.int64)

    def _sweep(self, room: int) -> None:
        """Keep the words that several texts had since the last time, the more of them the fewer stay."""
        n, least = len(self.at), 2
        while np.count_nonzero(self.met[:n] >= least) > self.keep // 2:
            least *= 2
        stay = np.flatnonzero(self.met[:n] >= least)
        if len(stay) + room > self.keep:
            return self._empty()
        self.signs[: len(stay)], self.mins[: len(stay)] = self.signs[stay], self.mins[stay]
        words = list(self.at)
        self.at = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.met[:] = 0

    def _number(self, word: str) -> int:
        i = self.at.setdefault(word, len(self.at))
        if i == len(self.signs):
            self.signs, self.mins, self.met = (np.concatenate([m, np.zeros_like(m)]) for m in (self.signs, self.mins, self.met))
        data, sha = word.encode(), hashlib.sha256
        self.signs[i] = np.unpackbits(np.frombuffer(sha(data).digest()[:8], np.uint8), bitorder="little").astype(np.int8) * 2 - 1
        self.mins[i] = np.frombuffer(b"".join([sha(s + data).digest() for s in self.salted]), "<u4")[::8]
        return i

    def sketches(self, text: str | None) -> tuple[int, np.ndarray]:
        """(SimHash: 64 votes of the words' hashes, repeats counted, as a signed number, 0 without words;
        MinHash: for each salt the smallest hash of the different words, the largest value without words)."""
        counts = Counter(m.group() for m in WORD.finditer((text or "").lower()))
        votes, mins = np.zeros(64, np.int64), np.full(len(self.salted), 0xFFFFFFFF, "<u4")
        each = iter(counts.items())
        while part := list(islice(each, self.chunk)):
            if len(self.at) + len(part) > self.keep:
                self._sweep(len(part))
            ids = np.array([self.at[w] if w in self.at else self._number(w) for w, _ in part])
            self.met[ids] += 1
            votes += np.array([n for _, n in part]) @ self.signs[ids]
            np.minimum(mins, self.mins[ids].min(axis=0), out=mins)
        return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0]), mins


@cache
def held() -> Hashed:
    """One for each worker process, so later tasks hash only what is new to it."""
    return Hashed()


def simhash(text: str | None) -> int:
    return Hashed(0).sketches(text)[0]


def minhash(text: str | None) -> list[int]:
    return Hashed().sketches(text)[1].tolist()


@lru_cache(200_000)
def _token_hash(token: str) -> int:
    return fnv1a(token.encode())


def _trigram_hashes(data: bytes) -> np.ndarray:
    """FNV-1a of every three bytes that follow each other, all at once."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = np.full(max(0, len(b) - 2), FNV_OFFSET, np.uint64)
    for i in range(3):
        h = (h ^ b[i : i + len(h)]) * np.uint64(FNV_PRIME)
    return h


def hash_embed(text: str) -> np.ndarray:
    lower = (text or "").lower()
    own = [_token_hash(t) for t in WORD.findall(lower) if len(t) > 1 or len(t.encode()) >= 2]
    near = _trigram_hashes(lower.encode())
    h = np.concatenate([np.array(own, np.uint64), near])
    size = np.concatenate([np.ones(len(own)), np.full(len(near), 0.5)])
    out = np.bincount((h % np.uint64(DIMENSIONS)).astype(np.int64), weights=np.where(h & np.uint64(1), -size, size), minlength=DIMENSIONS)
    if len(own) > MAX_TOKENS:
        out *= MAX_TOKENS / len(own)
    norm = np.sqrt((out**2).sum())
    if norm > 1e-12:
        return out / norm
    out[:] = 0
    out[0] = 1.0
    return out


@F.pandas_udf(T.LongType())
def simhash64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashed = Hashed(0)
    for texts in batches:
        yield pd.Series([hashed.sketches(t)[0] for t in texts], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash128(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashed = held()
    for texts in batches:
        yield pd.Series([hashed.sketches(t)[1].astype("int64") for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(hash_embed, na_action=None)


def fingerprint_similarity(s1: Column, m1: Column, s2: Column, m2: Column) -> Column:
    """Mean of the share of equal SimHash bits and the share of equal MinHash values."""
    same = F.aggregate(F.zip_with(m1, m2, lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    return 0.5 * (1 - F.bit_count(s1.bitwiseXOR(s2)) / 64) + 0.5 * same / SALTS


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda p, q: p + q)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size < 1e-12), 0.0).otherwise(dot(a, b) / size)


def register(spark) -> None:
    """Make the functions known to SQL under their names."""
    for name, f in (("simhash64", simhash64), ("minhash128", minhash128), ("hash_embedding", hash_embedding)):
        spark.udf.register(name, f)
