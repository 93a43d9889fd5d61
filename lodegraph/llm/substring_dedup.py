"""Substring deduplication: words in windows of `width` words that also stand elsewhere are removed.

Every window is named by its minimizer, the smallest hash of the runs of `gram` words in it; equal windows have the
same one.  Neighbouring windows with one minimizer form a segment, so a text yields one segment for about (width - gram) / 2
words and equal windows always meet under one key: routing segments by minimizer makes each shard's index complete for the
windows it gets, and no text has to be streamed through every shard.

Segments with the same words collapse to one with a count.  A minimizer with a single segment needs no search: its windows
are repeated if the count is 2 or more.  All other segments go to the shard of their minimizer, which builds an FM-index over
them (a wavelet matrix of the Burrows-Wheeler transform, see fm_index) and streams them through it: backward search gives
for each end how far back the words stand twice, and the windows that this covers are reported.  A minimizer with
more than LARGE different segments, such as the edge of a passage that very many documents share, would make one shard grow with
the corpus; its segments are cut into single windows, which are counted by their hash instead.

Defined cases: null and empty texts have no words; texts shorter than a window keep all words; repeated rows repeat each
other's windows; rows that share an id are told apart by their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import parted, sized_filter, small, written
from lodegraph.llm.fm_index import repeated_windows
from lodegraph.llm.words import BASE, hashes, mix, runs, split

LARGE = 2_000
#: About so many words are indexed by one task.
SHARD_WORDS = 400_000


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = np.ones((2, 1), np.uint64)


def _rolling(w: np.ndarray) -> np.ndarray:
    """Prefix sums of w[i] * BASE ** -(i + 1) and powers of BASE, modulo 2 ** 64."""
    global _powers
    if _powers.shape[1] <= len(w):  # a worker keeps the powers up to twice the longest text it has met
        steps = np.ones((2, 2 * len(w) + 2), np.uint64)
        steps[0, 1:], steps[1, 1:] = BASE, _INVERSE
        _powers = np.multiply.accumulate(steps, axis=1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * _powers[1, 1 : len(w) + 1], out=sums[1:])
    return np.stack([sums, _powers[0, : len(w) + 1]])


def first_least(g: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest of g[i : i + span], for every i: by stretches of doubling length."""
    at, least, have = np.arange(len(g)), g, 1
    while have < span:
        step = min(have, span - have)
        left = least[:-step] <= least[step:]
        at, least, have = np.where(left, at[:-step], at[step:]), np.where(left, least[:-step], least[step:]), have + step
    return at


def _run_hash(rolling: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of w[start:stop]: sum of w[i] * BASE ** (start - i - 1), which doesn't depend on where the run stands."""
    sums, powers = rolling
    return mix((sums[stop] - sums[start]) * powers[start] + (stop - start).astype(np.uint64))


def segments(w: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, last window) of each segment of the word hashes w."""
    if len(w) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = runs(w, gram)
    at = first_least(g, width - gram + 1)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[new]], new, np.concatenate([new[1:] - 1, [len(at) - 1]])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row is told by its id and its text, so that repeated ids do no harm.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def all_segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, body, row, first, last): minimizer, hash of the words, and the windows of every segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "body", "row", "first", "last"]
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = hashes(split(text.as_py()))
                key, first, last = segments(w, width, gram)
                if len(key):
                    body = _run_hash(_rolling(w), first, last + width)
                    for column, v in zip(out, (key.view(np.int64), body.view(np.int64), np.full(len(key), row), first, last)):
                        column.append(v)
            for i in range(0, len(out[0]), 2000):
                cols = [np.concatenate(c[i : i + 2000]) for c in out]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return _rows(docs).select("row", "text").mapInArrow(cut, "key long, body long, row long, first int, last int")


def _with_words(docs: DataFrame, wanted: DataFrame, width: int, windows: bool) -> DataFrame:
    """The words behind wanted (key, body, n, row, first, last): their hashes, or with windows a hash for each window."""
    rows = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "body", "n", "first", "last")).alias("parts"))
    near, _ = parted(_rows(docs).select("row", "text"), "row", sized_filter(rows, "row"))
    near = near.dropDuplicates(["row"]).join(rows, "row")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for text, parts in zip(batch.column(0), batch.column(1)):
                w = hashes(split(text.as_py()))
                cols: list[list] = [[], [], [], []]
                for p in parts.as_py():
                    body = w[p["first"] : p["last"] + width]
                    if windows:
                        s = np.arange(p["first"], p["last"] + 1)
                        body = _run_hash(_rolling(w), s, s + width)
                    for column, v in zip(cols, (p["key"], p["body"], p["n"], body.view(np.int64))):
                        column.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "body", "n", "words"])

    return near.select("text", "parts").mapInArrow(take, "key long, body long, n long, words array<long>")


def _runs_of(starts: np.ndarray) -> list[list[int]]:
    """Sorted window starts as [from, to] pairs."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return [[int(a), int(b)] for a, b in zip(starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])])]


def search_shards(bodies: DataFrame, width: int, shards: int) -> DataFrame:
    """(key, body, spans): of each segment, the windows that stand twice, by an FM-index for each shard."""

    def search(key, t):
        words = [np.asarray(x.values).view(np.uint64) for x in t["words"]]
        found = repeated_windows(words, t["n"].to_numpy(), width)
        hit = [i for i, f in enumerate(found) if len(f)]
        spans = pa.array([_runs_of(found[i]) for i in hit], pa.list_(pa.list_(pa.int32())))
        take = pa.array(hit, pa.int64())
        return pa.table({"key": t["key"].take(take), "body": t["body"].take(take), "spans": spans})

    placed = bodies.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return placed.groupBy("shard").applyInArrow(search, "key long, body long, spans array<array<int>>")


def count_windows(windows: DataFrame) -> DataFrame:
    """(key, body, spans) of segments that were cut into single windows."""
    each = windows.select("key", "body", "n", F.posexplode("words").alias("at", "w"))
    often = each.groupBy("key", "w").agg(F.sum("n").alias("total")).filter("total > 1").select("key", "w")
    hit = each.join(often, ["key", "w"], "left_semi").groupBy("key", "body").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return hit.select("key", "body", F.expr("transform(at, x -> array(x, x))").alias("spans"))


def repeated_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, spans): the repeated windows of every row that has any, as [first window, last window]."""
    found = written(all_segments(docs, width, gram), "all-segments")
    stats = found.groupBy("key").agg(F.count("*").alias("n"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    # Written, so that the join below has a side of single keys and one that may be split where a key is hot.
    twice = written(stats.filter("n > 1").select("key", (F.col("b0") != F.col("b1")).alias("mixed")), "twice")
    found = written(found.join(twice, "key"), "segments")
    bodies = found.filter("mixed").groupBy("key", "body").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("p"))
    bodies = bodies.select("key", "body", "n", "p.row", "p.first", "p.last")
    large = written(bodies.groupBy("key").count().filter(F.col("count") > LARGE).select("key"), "large")
    few = bodies.join(large, "key", "left_anti")
    words = written(_with_words(docs, few, width, False), "bodies")
    total = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    spans = search_shards(words, width, max(1, int(total) // SHARD_WORDS + 1))
    if not large.isEmpty():
        spans = spans.union(count_windows(written(_with_words(docs, bodies.join(large, "key", "left_semi"), width, True), "windows")))
    spans = written(spans, "spans")
    # A minimizer with one segment: every window is repeated.
    plain = found.filter("NOT mixed").select("row", F.array("first", "last").alias("span"))
    rest = found.filter("mixed").join(spans, ["key", "body"]).select("row", "first", F.explode("spans").alias("s"))
    rest = rest.select("row", F.expr("array(first + s[0], first + s[1])").alias("span"))
    return plain.union(rest).distinct().groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 35, gram: int = 8, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row for each row of docs."""
    spans = written(repeated_spans(docs, width, gram), "row-spans")
    near, free = parted(_rows(docs), "row", sized_filter(spans, "row"))
    touched = near.join(spans, "row", "left")
    free = free.withColumn("spans", F.lit(None).cast("array<array<int>>"))
    cols = ["doc_id", "text", "spans"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = split(text.as_py())
                gone = np.zeros(len(words) + 1, np.int64)
                for a, b in spans.as_py() or []:
                    gone[a] += 1
                    gone[b + width] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                joined = b" ".join(kept)
                for column, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode())):
                    column.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols_ = [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays(cols_[:n], names=names[:n])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return touched.select(*cols).union(free.select(*cols)).mapInArrow(cut, schema)
