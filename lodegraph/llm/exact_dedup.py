"""Exact deduplication by a log-structured merge index, with DataFrame operations only.

Rows are routed to memtables by a hash of their id, so a group of copies, however large, spreads over all
memtables.  Each memtable flushes one run: a Parquet file sorted by SHA-256 digest, one entry for each digest
with the ids under it, carrying Parquet's own bloom filter and min/max for the digest column.  Compaction merges
the runs: one entry for each digest with the largest id (or smallest) and the group's size.  Digests that
compaction found more than once are hits.  A bitmap of the hits filters a second scan of the texts, and
the texts that pass are grouped by digest and bytes, combined map-side; a digest with two different texts ends the
job with an error, so a result never rests on the digest alone.

Later documents are absorbed into a written index the same way, as one more level: a filter of their digests picks the entries
that a merge may change.

Defined cases: a null text counts as empty; an empty table gives an empty result; a null id is below every other
id; rows that repeat both id and text count each, and exactly one of them stays; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import parted, sized_filter, text_or_empty, written


def memtable_runs(docs: DataFrame, memtable_rows: int, least: int) -> DataFrame:
    """Sorted digest runs: (memtable, digest, ids)."""
    n = max(least, math.ceil(docs.count() / memtable_rows))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"),
    ).withColumn("memtable", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    runs = (
        rows.repartition(n, "memtable")
        .groupBy("memtable", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("ids"))
        .sortWithinPartitions("memtable", "digest")
    )
    return written(runs, "dedup-runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge runs: (digest, keep_id, group_size)."""
    at = (F.array_max if keep == "largest" else F.array_min)("ids.doc_id")
    merged = runs.select("digest", at.alias("best"), F.size("ids").alias("n")).groupBy("digest")
    best = F.max("best") if keep == "largest" else F.min("best")
    return merged.agg(best.alias("keep_id"), F.sum("n").alias("group_size"))


def absorb(index: DataFrame, docs: DataFrame, keep: str = "largest", memtable_rows: int = 1_000_000, least_memtables: int = 8) -> DataFrame:
    """The index (digest, keep_id, group_size) with later documents in it: their runs are flushed and compacted, and a filter of their
    digests picks the entries of the index that are merged with them; the others stay as they are, unsorted and unshuffled."""
    fresh = written(compact(memtable_runs(docs, memtable_rows, least_memtables), keep), "dedup-level")
    near, far = parted(index, "digest", sized_filter(fresh, "digest"))
    best = F.max("keep_id") if keep == "largest" else F.min("keep_id")
    merged = near.union(fresh.select(near.columns)).groupBy("digest").agg(best.alias("keep_id"), F.sum("group_size").alias("group_size"))
    return far.union(merged.select(far.columns))


def verify(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Compare the bytes behind every hit: (digest, n_texts), for hits and a few digests that the filter let through."""
    hits = index.filter("group_size > 1").select("digest")
    texts = docs.select(text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    passed, _ = parted(texts, "digest", sized_filter(hits, "digest"))
    return passed.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("n_texts"))


def exact_dedup(
    spark: SparkSession, docs: DataFrame, keep: str = "largest", memtable_rows: int = 1_000_000, least_memtables: int = 48
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    runs = memtable_runs(docs, memtable_rows, least_memtables)
    index = written(compact(runs, keep), "dedup-index")
    checked = index.join(verify(docs, index), "digest", "left").select(
        "digest",
        F.when(F.col("group_size") == 1, F.col("keep_id"))
        .when(F.col("n_texts") == 1, F.col("keep_id"))
        .otherwise(F.raise_error(F.lit("texts that differ share a SHA-256 digest")).cast("long"))
        .alias("keep_id"),
        "group_size",
    )
    # A digest has one entry in each run at most, so no side of this join has a hot key.
    first = F.array_position(F.col("ids.doc_id"), F.col("keep_id"))
    rows = runs.join(checked, "digest").withColumn("first", first - 1)
    rows = rows.select("digest", "keep_id", "group_size", "first", F.posexplode("ids").alias("at", "id"))
    stays = F.when(F.col("keep_id").isNull(), F.col("at") == 0).otherwise(F.col("at") == F.col("first"))
    return rows.select(
        F.col("id.doc_id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(stays, F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
