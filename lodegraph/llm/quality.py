"""A quality classifier without hand labels: a weak-label model and a hashed linear scorer.

Heuristic labellers look at each text and say good, bad or nothing.  How often each pattern of votes occurs is counted
over all documents; expectation-maximisation on those counts estimates how often each labeller is right about good and
about bad texts, and with that the posterior of every pattern.  A linear scorer over hashed word shapes is then fitted
to the posteriors of a bounded sample and scores every document; it sees what the labellers don't, and a document
is kept if its score is 0.5 or more.  A text is read once for votes and word shapes, which are written; only where all
columns of the kept rows are asked for (good_only) are texts read again, for the score alone.

The sample for the scorer has about sample_rows rows, fewer if they would hold more than SAMPLE_BYTES of text; a hash of the id
draws it.  A sample that comes out empty although there are rows is an error.

Defined cases: a null or empty text gets no votes, the prior as its posterior and the scorer's bias as its score;
repeated rows are scored each; with an empty table the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import lowest, mark, small, written
from lodegraph.llm.hashed import Rows, logistic, sigmoid

#: At most so many rows, and about so much text, are drawn for the fit of the scorer.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 256_000_000
SHAPE_BITS = 16
SYMBOLS = frozenset("#$%&*@^~<>{}[]\\=+_")
GOOD, BAD, SILENT = "1", "0", "-"


def _between(value: float, good: float, bad: float) -> str:
    """Low values are good, high ones bad, those between say nothing."""
    return GOOD if value <= good else BAD if value >= bad else SILENT


def symbol_share(text, words):
    return _between(sum(map(text.count, SYMBOLS)) / len(text), 0.01, 0.05)


def symbol_words(text, words):
    return _between(sum(w[-1] in SYMBOLS for w in words) / len(words), 0.05, 0.3)


def capitals(text, words):
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return _between(upper / max(1, sum(map(len, words))), 0.12, 0.3)


def shouting(text, words):
    return _between(text.count("!") / len(words), 0.02, 0.3)


def tables(text, words):
    return _between(text.count("|") / len(words), 0.02, 0.15)


def wordless(text, words):
    return _between(sum(not any(map(str.isalnum, w)) for w in words) / len(words), 0.05, 0.2)


def stutter(text, words):
    same = sum(a == b for a, b in zip(words, words[1:]))
    return _between(same / len(words), 0.05, 0.3)


def variety(text, words):
    """The share of repeated words, within stretches of about 2000 words: over longer ones it grows with the length alone."""
    if len(words) < 30:
        return SILENT
    stretch = len(words) / -(-len(words) // 2000)
    cuts = [round(i * stretch) for i in range(round(len(words) / stretch) + 1)]
    return _between(1 - sum(len(set(words[a:b])) for a, b in zip(cuts, cuts[1:])) / len(words), 0.6, 0.8)


def sentences(text, words):
    ends = sum(w[-1] in ".!?…" for w in words)
    return GOOD if 3 <= len(words) / max(1, ends) <= 40 else SILENT


def word_length(text, words):
    mean = sum(map(len, words)) / len(words)
    return GOOD if 3 <= mean <= 8 else BAD if mean > 14 or mean < 2 else SILENT


LABELLERS = (symbol_share, symbol_words, capitals, shouting, tables, wordless, stutter, variety, sentences, word_length)


def votes(text: str | None) -> str:
    words = (text or "").split()
    return "".join(f(text, words) for f in LABELLERS) if words else SILENT * len(LABELLERS)


def fit_labellers(patterns: dict[str, int], steps: int = 200) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """Expectation-maximisation on counted vote patterns: posterior of good by pattern, (right on good, right on bad) by labeller, prior."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([[{GOOD: 1, BAD: -1, SILENT: 0}[c] for c in k] for k in keys]).reshape(-1, len(LABELLERS))
    # Each labeller finds one kind of bad text and little else, so one vote against a text is where the estimate starts.
    post = np.where((v == -1).any(1), 0.1, 0.9) if len(keys) else np.zeros(0)
    right_good = right_bad = np.full(len(LABELLERS), 0.8)
    prior = 0.8
    for _ in range(steps):
        good, bad = n * post, n * (1 - post)
        prior = (good.sum() + 1) / (n.sum() + 2)
        # Pseudo-counts hold accuracies above chance, so that the classes can't change places.
        right_good = np.clip((good @ (v == 1) + 9) / (good @ (v != 0) + 10), 0.5, 0.9995)
        right_bad = np.clip((bad @ (v == -1) + 8) / (bad @ (v != 0) + 10), 0.05, 0.9995)
        logit = np.log(prior / (1 - prior))
        logit = logit + (v == 1) @ np.log(right_good / (1 - right_bad)) + (v == -1) @ np.log((1 - right_good) / right_bad)
        post = sigmoid(logit)
    return dict(zip(keys, post.tolist())), list(zip(right_good.tolist(), right_bad.tolist())), float(prior)


RUNS = re.compile(r"([a-z])[a-z]*|([A-Z])[A-Z]*|([0-9])[0-9]*|(.)\4*", re.S)


def _shape(word: str) -> int:
    """Hash of a word's shape: runs of small letters, capitals and digits as one, repeated signs as two."""
    def run(m):
        if m[1] or m[2] or m[3]:
            return "a" if m[1] else "A" if m[2] else "0"
        c = m[4]
        return ("A" if c.isupper() else "a" if c.isalpha() else c * min(2, len(m[0])))

    return zlib.crc32(re.sub(r"a+", "a", RUNS.sub(run, word)).encode()) & ((1 << SHAPE_BITS) - 1)


class Shapes(dict):
    def __missing__(self, word):
        if len(self) >= 150_000:
            self.clear()
        self[word] = out = _shape(word)
        return out


SAME = zlib.crc32(b" same as before") & ((1 << SHAPE_BITS) - 1)


def features(text: str | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values): the square root of each shape's share of the words, and of words that repeat the one before."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    cols, n = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), return_counts=True)
    same = sum(map(str.__eq__, words, words[1:]))
    return np.append(cols, SAME), np.sqrt(np.append(n, same) / len(words))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_mark():
    """Rows of the same id and text have the same; so of rows that repeat both, the fit reads one."""
    return mark(F.col("doc_id").cast("long"), F.col("text").cast("string"), 3)


def looked_at(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, cols, vals) of every row: its votes, and its word shapes as bytes of uint16 and of float32."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in small(batches):
            texts = [t.as_py() for t in batch.column(1)]
            found = [features(t, shapes) for t in texts]
            cols, vals = [c.astype("<u2").tobytes() for c, _ in found], [v.astype("<f4").tobytes() for _, v in found]
            arrays = [batch.column(0), pa.array([votes(t) for t in texts], pa.string()), pa.array(cols, pa.binary()), pa.array(vals, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "votes", "cols", "vals", "mark"])

    return _rows(docs).withColumn("mark", row_mark()).mapInArrow(each, "doc_id long, votes string, cols binary, vals binary, mark long")


def counted(said: DataFrame) -> dict[str, int]:
    """How often each pattern of votes occurs; 3 ** labellers patterns at most."""
    return {r.votes: r["count"] for r in said.groupBy("votes").count().collect()}


def vote_patterns(docs: DataFrame) -> dict[str, int]:
    """How often each pattern occurs over all documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([votes(t.as_py()) for t in batch.column(0)], pa.string())], names=["votes"])

    return counted(_rows(docs).select("text").mapInArrow(each, "votes string"))


def sample_bound(docs: DataFrame, sample_rows: int) -> int:
    """The rows that keep both bounds, as texts are of mean length; one at least."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    return max(1, int(min(sample_rows, SAMPLE_BYTES * n / max(1, size or 0))))


def fit_scorer(drawn: DataFrame, posterior: dict[str, float]) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows drawn (doc_id, votes, cols, vals)."""
    t = drawn.toArrow()
    t = t.sort_by([("doc_id", "ascending"), ("votes", "ascending"), ("cols", "ascending")])
    rows = Rows.of([np.frombuffer(x.as_py(), "<u2") for x in t["cols"]], [np.frombuffer(x.as_py(), "<f4") for x in t["vals"]])
    return logistic(rows, np.array([posterior[v] for v in t["votes"].to_pylist()]), 1 << SHAPE_BITS)


def fitted(docs: DataFrame, seen: DataFrame | None, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], float, np.ndarray, float]:
    """(posterior by pattern, prior, weights, bias); seen: looked_at(docs), where that is written."""
    patterns = vote_patterns(docs) if seen is None else counted(seen)
    posterior, _, prior = fit_labellers(patterns)
    posterior[SILENT * len(LABELLERS)] = prior
    rows, of_row = (docs, row_mark()) if seen is None else (seen, F.col("mark"))
    chosen = rows.filter(lowest(rows, of_row, sample_bound(docs, sample_rows)))
    some = looked_at(chosen) if seen is None else chosen
    return posterior, prior, *fit_scorer(some.dropDuplicates(["mark"]), posterior)


def classify(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, votes, posterior, score, keep), one row for each row of docs."""
    seen = written(looked_at(docs), "votes")
    posterior, prior, weights, bias = fitted(docs, seen, sample_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            said = batch.column(1).to_pylist()
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            score = sigmoid(np.array([weights[np.frombuffer(c, "<u2")] @ np.frombuffer(v, "<f4") + bias for c, v in found]))
            post = pa.array([posterior.get(v, prior) for v in said], pa.float64())
            arrays = [batch.column(0), batch.column(1), post, pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "votes", "posterior", "score", "keep"])

    return seen.mapInArrow(each, "doc_id long, votes string, posterior double, score double, keep boolean")


def good_only(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    _, _, weights, bias = fitted(docs, None, sample_rows)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in small(batches):
            found = (features(None if (v := t.as_py()) is None else str(v), shapes) for t in batch.column(at))
            score = sigmoid(np.array([weights[c] @ v.astype("<f4") + bias for c, v in found]))
            yield batch.filter(pa.array(score >= 0.5, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
