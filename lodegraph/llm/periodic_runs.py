"""Periodic runs of words by a scan of all lags: a text's word ids are compared with themselves shifted by every lag.

A stretch of places where word i equals word i + q, long enough for the least exponent, is a run of period q.  At lag q a
stretch of `need` places holds one of every `need`, so those are compared first and the texts they point to are compared in
full; nothing is missed.  A batch of texts is scanned at once, longest first, with ids that no two texts share, so a lag costs a few
numpy calls over the texts that are long enough for it.

A stretch with lag q is a run with smallest period q unless its smallest period p is a divisor of q; then the lag p has the
same stretch.  So of stretches with the same ends the smallest lag counts.

Texts of up to LONG_BYTES are scanned where they are read.  Longer ones are split: their (text, range of lags) pairs are dealt
out over the cluster, and their runs meet by id and text.

Defined cases: a null text counts as empty (no runs); a null id gets no planted period; repeated rows each have a row; any
column but doc_id and text is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import small, text_or_empty

#: Longer texts are scanned in ranges of lags, one for each LONG_BYTES; words that are scanned at once.
LONG_BYTES, BATCH_WORDS = 1 << 16, 400_000

RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"
)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a period from some word on in about one of ten documents, as a hash of the id says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, and only those, have the same number below len(words)."""
    last = dict(zip(words, range(len(words))))
    return np.fromiter(map(last.__getitem__, words), np.int32, len(words))


def _stretches(w: np.ndarray, first: int, stop: int, q: int, need: int) -> np.ndarray:
    """(start, end) of what has period q between first and stop and is long enough."""
    same = np.zeros(stop - first - q + 2, np.int8)
    np.equal(w[first : stop - q], w[first + q : stop], out=same[1:-1].view(np.bool_))
    edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
    found = edges[edges[:, 1] - edges[:, 0] >= need]
    return found + np.array([first, first + q])


def scan(w: np.ndarray, sizes: np.ndarray, low: int, high: int, least: int = 12, exponent: float = 2.0) -> np.ndarray:
    """(start, end, period) of the runs with low <= period <= high of texts that lie one after another, longest first.

    No id may be in two texts.  Sorted; of equal stretches the smallest period.
    """
    ends, found = np.cumsum(sizes), []
    ups = -np.asarray(sizes, np.int64)
    for q in range(low, min(high, int(int(sizes[0]) // exponent) if len(sizes) else 0) + 1):
        texts = np.searchsorted(ups, -max(least, exponent * q), side="right")
        if not texts:
            break
        stop, need = int(ends[texts - 1]), max(least - q, int(np.ceil((exponent - 1) * q)), 1)
        at = np.flatnonzero(w[need - 1 : stop - q : need] == w[need - 1 + q : stop : need])
        if not len(at):
            continue
        at, half = at * need + need - 1, need // 2
        after = np.minimum(at + half, stop - q - 1)
        at = at[(w[at - half] == w[at - half + q]) | (w[after] == w[after + q])]
        for t in np.unique(np.searchsorted(ends, at, side="right")):
            runs = _stretches(w, int(ends[t] - sizes[t]), int(ends[t]), q, need)
            if len(runs):
                found.append(np.column_stack([runs, np.full(len(runs), q)]))
    return smallest(np.concatenate(found) if found else np.zeros((0, 3), np.int64))


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same ends that with the smallest period, by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _row(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """A document's row of RESULT from its runs (start, end, period) by start, then period."""
    kept, best = words, (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    if len(runs):
        size = runs[:, 1] - runs[:, 0]
        k = int(np.argmax(size))  # the first of the longest: smallest start, then period
        s, q, n = int(runs[k, 0]), int(runs[k, 2]), int(size[k])
        best = s, n, q, 1000 * n // q
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(kept)))
    return doc_id, len(runs), *best, *digests, len(words)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
    return pa.record_batch([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * len(names), kinds, strict=True)], names)


def _texts(batches, plant: bool, rows: int = 256):
    """(row, words) of each row."""
    for batch in small(batches, rows):
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "text"}
            words = text.as_py().split()
            yield row, planted(words, row["doc_id"]) if plant else words


def _scanned(batches, plant: bool, least: int, exponent: float):
    held, size = [], 0

    def flush():
        order = sorted(range(len(held)), key=lambda i: -len(held[i][1]))
        sizes = np.array([len(held[i][1]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        w = np.concatenate([word_ids(held[i][1]) + np.int32(s) for i, s in zip(order, starts.tolist())])
        runs = scan(w, sizes, 1, len(w), least, exponent)
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(order) + 1))
        rows = [None] * len(held)
        for k, i in enumerate(order):
            own = runs[cuts[k] : cuts[k + 1]] - np.array([starts[k], starts[k], 0])
            rows[i] = _row(held[i][0]["doc_id"], held[i][1], own)
        return _rows(rows)

    for row, words in _texts(batches, plant):
        held.append((row, words))
        size += len(words) + 1
        if size >= BATCH_WORDS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _range_of_lags(batches, plant: bool, least: int, exponent: float):
    for row, words in _texts(batches, plant, 1):
        lags = int(len(words) // exponent)
        low, high = 1 + row["share"] * lags // row["shares"], (row["share"] + 1) * lags // row["shares"]
        runs = scan(word_ids(words), np.array([len(words)], np.int64), low, high, least, exponent)
        n = len(runs)
        yield pa.record_batch([pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["sha"]] * n, pa.binary()), *(pa.array(runs[:, i], pa.int64()) for i in range(3))], ["doc_id", "sha", "start", "stop", "period"])


def _joined(batches, plant: bool):
    for row, words in _texts(batches, plant, 1):
        runs = np.array([(r["start"], r["stop"], r["period"]) for r in row["runs"] or []], np.int64).reshape(-1, 3)
        yield _rows([_row(row["doc_id"], words, smallest(runs))])


def periodic_runs(spark: SparkSession, docs: DataFrame, least: int = 12, exponent: float = 2.0, plant: bool = False, long_bytes: int = LONG_BYTES) -> DataFrame:
    """RESULT for each row of docs: its runs of `least` words and `exponent` periods or more, the longest of them, and what is left
    when each run keeps its first period alone.  plant: documents get periods first, as planted() says."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = F.octet_length("text")
    near = texts.filter(size <= long_bytes).mapInArrow(lambda b: _scanned(b, plant, least, exponent), RESULT)
    far = texts.filter(size > long_bytes).withColumn("sha", F.unhex(F.sha2("text", 256)))
    shares = far.withColumn("shares", F.ceil(size / long_bytes).cast("long")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = shares.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = dealt.mapInArrow(lambda b: _range_of_lags(b, plant, least, exponent), "doc_id long, sha binary, start long, stop long, period long")
    runs = runs.groupBy("doc_id", "sha", "start", "stop").agg(F.min("period").alias("period"))
    runs = runs.groupBy(F.col("doc_id").alias("id"), F.col("sha").alias("of")).agg(F.collect_list(F.struct("start", "stop", "period")).alias("runs"))
    met = far.join(runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left").select("doc_id", "text", "runs")
    return near.union(met.mapInArrow(lambda b: _joined(b, plant), RESULT))
