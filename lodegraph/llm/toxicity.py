"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled text.  A linear classifier over hashed
words and word beginnings is fitted in numpy to the class-prior-corrected risk: prior * R+(positives) plus the negative part
R-(unlabelled) - prior * R-(positives).  Where that part falls below zero on a batch the step goes the other way, which
keeps a flexible model from fitting the positives as negatives of the unlabelled.  The class prior is the share of
toxic rows among the labelled ones that may be learned from.

Only labels of rows whose crc32(doc_id as text) mod `folds` is not 0 are read.  The fit uses about most_positive toxic and
most_unlabelled other documents (labelled or not) at most, fewer if they would hold more than SAMPLE_BYTES of text; a hash of
the id decides which, and a sample that comes out empty is an error.  Every document is scored.

Defined cases: null and empty texts get the score of a text without any known word; repeated rows are scored each; rows with
contradicting labels count as toxic; without any toxic row no document scores above 0.5; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import lowest, mark, small
from lodegraph.llm.hashed import Adam, Rows, sigmoid

MAX_POSITIVE, MAX_UNLABELLED, SAMPLE_BYTES = 3_000, 7_000, 256_000_000
BITS = 20
BEGINNINGS = (2, 3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def held_out(folds: int = 5):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings."""
    mask = (1 << BITS) - 1
    return (zlib.crc32(b"=" + word.encode()) & mask, *(zlib.crc32(word[:n].encode()) & mask for n in BEGINNINGS if len(word) > n))


class Known(dict):
    """word -> its features, but only those that `kept` has."""

    def __init__(self, kept=None):
        self.kept = kept

    def __missing__(self, word):
        if len(self) >= 150_000:
            self.clear()
        found = word_features(word)
        self[word] = out = found if self.kept is None else tuple(f for f in found if f in self.kept)
        return out


def features(text: str | None, known: Known) -> set[int]:
    return set().union(*map(known.__getitem__, set(WORD.findall((text or "").lower()))))


def fit(positive: Rows, unlabelled: Rows, prior: float, size: int, steps: int = 300, rate: float = 0.1, shrink: float = 0.1, seed: int = 7):
    """Weights and bias under the non-negative risk, with the logistic loss, in batches of half; steps get smaller, so the end is steady."""
    rng, w, opt = np.random.default_rng(seed), np.zeros(size + 1), Adam(size + 1, rate)
    w[size] = np.log(prior / (1 - prior))
    po, uo = positive.owner(), unlabelled.owner()
    for step in range(steps):
        opt.rate = rate * (1 - step / steps)
        p = sigmoid(positive.dot(w[:size], po) + w[size])
        u = sigmoid(unlabelled.dot(w[:size], uo) + w[size])
        pick_p = (rng.random(len(p)) < 0.5) / max(1, 0.5 * len(p))
        pick_u = (rng.random(len(u)) < 0.5) / max(1, 0.5 * len(u))
        # The loss of a positive is -log p, of a negative -log(1 - p); their slopes in the margin are p - 1 and p.
        negative = -(pick_u @ np.log1p(-np.minimum(u, 1 - 1e-12))) + prior * (pick_p @ np.log1p(-np.minimum(p, 1 - 1e-12)))
        if negative >= 0:
            gp, gu = prior * pick_p * (p - 1) - prior * pick_p * p, pick_u * u
        else:
            gp, gu = prior * pick_p * p, -pick_u * u
        g = np.append(positive.spread(gp, po, size) + unlabelled.spread(gu, uo, size), gp.sum() + gu.sum())
        w = opt.step(w, g)
        w[:size] = np.sign(w[:size]) * np.maximum(0, np.abs(w[:size]) - opt.rate * shrink)
    return w[:size], float(w[size])


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, most_positive: int = MAX_POSITIVE, most_unlabelled: int = MAX_UNLABELLED
) -> tuple[dict[int, float], float]:
    """(weight by feature, bias)."""
    open_ = labels.filter(~held_out(folds) & F.col("toxic").isNotNull())
    by_doc = open_.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, n_toxic = by_doc.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return {}, -20.0
    prior = min(0.9, max(1e-4, n_toxic / n))
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    # Both samples together hold about SAMPLE_BYTES at most, as their texts are of mean length; one row each at least.
    rows_at_most = SAMPLE_BYTES / max(1.0, (size or 0) / max(1, n_docs))
    bound = lambda most: max(1, int(min(most, rows_at_most / 2)))
    # most_positive ids at most: small enough for any executor.
    toxic = by_doc.filter(F.col("toxic") == 1).select("doc_id")
    sure = toxic.filter(lowest(toxic, mark("doc_id", F.lit(0), 1), bound(most_positive))).withColumn("known", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out(folds))
    rows = rows.join(F.broadcast(sure), "doc_id", "left")
    of_row, known = mark("doc_id", "text", 2), F.coalesce(F.col("known"), F.lit(False))
    positive = known & lowest(rows.filter(known), of_row, bound(most_positive))
    free = lowest(rows, of_row, bound(most_unlabelled))
    rows = rows.select("doc_id", "text", positive.alias("sure"), free.alias("free"), of_row.alias("mark")).filter("sure OR free").dropDuplicates(["mark"])
    rows = rows.select("doc_id", "text", "sure", "free")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in small(batches):
            found = [np.sort(np.fromiter(features(t.as_py(), known), np.int32)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2), b.column(3)], names=["doc_id", "cols", "sure", "free"])

    t = rows.mapInArrow(each, "doc_id long, cols binary, sure boolean, free boolean").toArrow()
    if not any(t["sure"].to_pylist()):  # no toxic document can be read: the share of toxic labels is all that is known
        return {}, float(np.log(prior / (1 - prior)))
    t = t.sort_by([("doc_id", "ascending"), ("cols", "ascending")])
    cols = [np.frombuffer(x.as_py(), np.int32) for x in t["cols"]]
    sure_at, free_at = (np.flatnonzero(t[k].to_numpy()) for k in ("sure", "free"))
    seen = np.zeros(1 << BITS, np.int32)
    for i in sure_at:
        seen[cols[i]] += 1
    kept = np.flatnonzero(seen >= max(3, len(sure_at) // 400))
    at = np.full(1 << BITS, -1)
    at[kept] = np.arange(len(kept))
    narrow = lambda c: (x := at[c])[x >= 0]
    w, bias = fit(Rows.of([narrow(cols[i]) for i in sure_at]), Rows.of([narrow(cols[i]) for i in free_at]), prior, len(kept))
    return {int(f): float(v) for f, v in zip(kept, w) if abs(v) > 1e-6}, bias


def score(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, most_positive: int = MAX_POSITIVE, most_unlabelled: int = MAX_UNLABELLED
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    weights, bias = train(docs, labels, folds, most_positive, most_unlabelled)  # 2**BITS weights at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(weights)
        for b in small(batches):
            z = np.array([bias + sum(map(weights.__getitem__, sorted(features(t.as_py(), known)))) for t in b.column(1)])
            s = sigmoid(z)
            arrays = [b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out(folds), F.lit(False)))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
