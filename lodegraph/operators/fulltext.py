"""Full text over a stored inverted index: stemmed terms with positions, read by term.

Words are runs of letters and digits, lower-cased, without Latin accents, and stemmed.  The index is a folder:

    postings/bucket=NN   (term, key, length, positions), each file sorted by term and key
    terms/bucket=NN      (term, df, cf)
    stats                (n_docs, n_tokens)

A term's bucket follows from its first two characters, so a term, or all terms that begin with two or more given characters, are
in one bucket: a query reads the buckets of its words, and within them the row groups that may hold the terms.  A bucket
is cut by a hash of the key over several files.

A query is a list of phrases, each a list of words; a phrase is in a text where its words follow each other in one column, the
last of them whole or, with `prefix`, as a beginning.  Phrases are joined by "and" or "or".
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.stem import stem

#: Latin letters with marks and the letters they are without, by their decomposition.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r}
_MARKED = {c: x for c, x in _MARKED.items() if x != c and x.isascii() and x.isalpha() and c == c.lower()}
ACCENTED, PLAIN = "".join(_MARKED), "".join(_MARKED.values())

HEAD = 2

#: Words that a task looks at together, but for a text that has more.
WORDS_AT_ONCE = 500_000

#: Files for each partition that the postings are dealt over.
CUTS = 4

#: FTS ranking constants, and the least idf (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    """Folded words in order, repeats kept, not stemmed."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class Index:
    spark: SparkSession
    path: str
    buckets: int
    key_type: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"term string, key {self.key_type}, length int, positions array<int>, bucket int").parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, cf long, bucket int").parquet(f"{self.path}/terms")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.schema("n_docs long, n_tokens long").parquet(f"{self.path}/stats")

    def bucket_of(self, term: str) -> int:
        return _bucket(term, self.buckets)


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term[:HEAD].encode()) % buckets


def _posted(batches, buckets: int):
    """(term, key, length, positions, bucket) of texts (key, length, w): a row for each stem of a text, of some texts at a time by bucket and
    term, so that the sort behind it merges runs.  Each different word of these texts is stemmed once."""
    for batch in batches:
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WORDS_AT_ONCE, "right")))
            key, length, lists = batch.slice(i, j - i).columns
            sizes = np.diff(ends[i:j], prepend=ends[i - 1] if i else 0)
            i = j
            flat = lists.flatten()
            text = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            coded = flat.dictionary_encode()
            stems = [stem(w) for w in coded.dictionary.to_pylist()]
            terms = sorted((_bucket(t, buckets), t) for t in set(stems))
            place = {t: n for n, (_, t) in enumerate(terms)}
            held = flat.is_valid().to_numpy(zero_copy_only=False)
            term = np.array([place[t] for t in stems], np.int64)[coded.indices.drop_null().to_numpy()]
            text, at = text[held], at[held].astype(np.int32)
            group = term * len(sizes) + text
            order = np.argsort(group, kind="stable")  # so positions stay ascending
            group, at = group[order], at[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            own, named = pa.array(group[first] % len(sizes)), pa.array(group[first] // len(sizes))
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at))
            bucket, name = pa.array([b for b, _ in terms], pa.int32()), pa.array([t for _, t in terms], pa.string())
            columns = [name.take(named), key.take(own), length.take(own), positions, bucket.take(named)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "length", "positions", "bucket"])


def build_index(docs: DataFrame, key: str, columns: list[str], path: str, buckets: int = 32) -> Index:
    """Write the index of some text columns under a path all executors share.  Keys are taken to be unique; null texts are empty.

    Words of different columns are never next to each other."""
    spark = docs.sparkSession
    lists = [words(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    gap = F.array(F.lit(None).cast("string"))
    joined = reduce(lambda a, b: F.concat(a, gap, b), lists)
    texts = docs.select(F.col(key).alias("key"), joined.alias("w"), reduce(lambda a, b: a + b, map(F.size, lists)).alias("length"))
    schema = f"term string, key {docs.schema[key].dataType.simpleString()}, length int, positions array<int>, bucket int"
    held = texts.select("key", "length", "w").mapInArrow(lambda batches: _posted(batches, buckets), schema)
    # A hash deals them in one pass, where ranges would have all texts stemmed once more to find their bounds.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    cut = F.pmod(F.xxhash64("key"), F.lit(-(-CUTS * parts // buckets)))
    dealt = held.repartition(parts, "bucket", cut).sortWithinPartitions("bucket", "term", "key")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(spark, path, buckets, docs.schema[key].dataType.simpleString())
    terms = index.postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("cf"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    stats = index.terms.agg(F.lit(docs.count()).cast("long").alias("n_docs"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    return index


def phrases_of(spark: SparkSession, query: str) -> list[list[str]]:
    """A query's phrases, stemmed: what stands in double quotes, else each of its words; a word that folds into several is a phrase."""
    raw = [a or b for a, b in re.findall(r'"([^"]*)"|([^\s"]+)', query)]
    asked = spark.range(0, 1, 1, 1).select(F.posexplode(F.array(*map(F.lit, raw))).alias("at", "text")) if raw else spark.createDataFrame([], "at int, text string")
    rows = asked.select("at", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    out: dict[int, list[str]] = {}
    for r in sorted(rows.collect()):  # the words of one query
        out.setdefault(r.at, []).append(stem(r.term))
    return list(out.values())


def _hits(index: Index, phrases: list[list[str]], prefix: bool) -> DataFrame:
    """(key, length, phrase, n): how often each text has each phrase; from the buckets of its words alone."""
    slots = [(p, o, term, prefix and o == len(words) - 1) for p, words in enumerate(phrases) for o, term in enumerate(words)]
    held = [F.col("term").startswith(t) if begins else F.col("term") == t for _, _, t, begins in slots]
    wide = any(begins and len(t) < HEAD for *_, t, begins in slots)
    rows = index.postings if wide else index.postings.filter(F.col("bucket").isin(sorted({index.bucket_of(t) for _, _, t, _ in slots})))
    rows = rows.filter(reduce(lambda a, b: a | b, held))
    slot = F.struct  # (phrase, offset) of each slot that the term fills
    each = rows.withColumn("s", F.explode(F.array_compact(F.array(*[F.when(h, slot(F.lit(p).alias("phrase"), F.lit(o).alias("at"))) for h, (p, o, *_) in zip(held, slots)]))))
    sizes = {p: len(words) for p, words in enumerate(phrases)}
    single = [p for p, n in sizes.items() if n == 1] or [-1]
    alone = each.filter(F.col("s.phrase").isin(single)).groupBy("key", "length", F.col("s.phrase").alias("phrase")).agg(F.sum(F.size("positions")).alias("n"))
    longer = [p for p, n in sizes.items() if n > 1]
    if not longer:
        return alone
    size = F.element_at(F.create_map(*[F.lit(x) for p in longer for x in (p, sizes[p])]), F.col("phrase"))
    starts = each.filter(F.col("s.phrase").isin(longer)).select("key", "length", F.col("s.phrase").alias("phrase"), F.col("s.at").alias("at"), F.explode("positions").alias("pos"))
    full = starts.groupBy("key", "length", "phrase", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == size)
    return alone.union(full.groupBy("key", "length", "phrase").agg(F.count(F.lit(1)).alias("n")))


def search(index: Index, query: str, join: str = "and", prefix: bool = False) -> DataFrame:
    """(key) of the texts that have all ("and") or some ("or") of the query's phrases; none for a query without words."""
    phrases = phrases_of(index.spark, query)
    if not phrases:
        return index.postings.select("key").limit(0)
    per = _hits(index, phrases, prefix).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    return per.filter(F.col("m") >= (len(phrases) if join == "and" else 1)).select("key")


def ranked(index: Index, query: str, join: str = "and", prefix: bool = False, limit: int | None = 20) -> DataFrame:
    """(key, score), best first, ties by key: BM25 over phrases, each weighing by the texts that have it."""
    phrases = phrases_of(index.spark, query)
    if not phrases:
        return index.postings.select("key", F.lit(0.0).alias("score")).limit(0)
    hits = _hits(index, phrases, prefix)
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))  # a row for each phrase of the query
    met = hits.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(index.stats))  # one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") * F.col("n_docs") / F.col("n_tokens")))
    scored = met.groupBy("key").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("m"))
    out = scored.filter(F.col("m") >= (len(phrases) if join == "and" else 1)).select("key", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "key").limit(limit)
