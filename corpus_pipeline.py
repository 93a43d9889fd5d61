"""From raw documents to packed sequences: quality, exact and near duplicates, mixing, packing.

Each stage gets the documents that the one before kept, written as Parquet and read again, and decides on those alone.
All but the last return the columns of documents, all of them, whatever their names.  Duplicates are rows, not ids: rows
that share an id and differ in text are judged each.  Rows with a null id pass the stage of near duplicates; among copies a
null id is below every other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import exact_dedup, mixing, ngram_join, packing, quality
from lodegraph.llm.common import Scratch, columns_of, parted, sized_filter, table, unused, written


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_only(spark, docs)


def _keep_rows(docs: DataFrame, told: DataFrame, digest) -> DataFrame:
    """The rows of docs but for those that told (id, sha, stays) drops.

    A row is known by its id and a digest of its text.  Rows without an entry pass; of rows that repeat an entry that stays,
    the one whose columns have the least digest does: columns may be of types without an order.
    """
    told = written(told, "told")
    near, free = parted(docs, F.col("doc_id").cast("long"), sized_filter(told, "id"))
    rows = near.select(F.struct(*columns_of(near)).alias("row"))
    met = rows.join(told, F.col("row.doc_id").eqNullSafe(F.col("id")) & (digest(F.col("row.text")) == F.col("sha")), "left")
    once = met.filter("stays").groupBy("id", "sha").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return free.union(met.filter("stays IS NULL").select("row.*")).union(once.select("row.*"))


def _sha(text):
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest id, a null id below all others; of rows that repeat both, one."""
    found = exact_dedup.exact_dedup(spark, docs).filter("group_size > 1")
    return _keep_rows(docs, found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("stays")), _sha)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of similarity 0.8 or more connect, one: that with the smallest id; rows with that id by a hash of the text.

    Rows that share an id but are not alike are two documents here.
    """
    rows = written(ngram_join.row_groups(docs).filter("NOT alone"), "row-groups")
    firsts = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("tk").alias("sha"))).alias("first"))
    firsts = firsts.select("first.*", F.lit(True).alias("first"))
    told = rows.select(F.col("doc_id").alias("id"), F.col("tk").alias("sha")).distinct().join(firsts, ["id", "sha"], "left")
    told = told.select("id", "sha", F.coalesce("first", F.lit(False)).alias("stays"))
    return _keep_rows(docs, told, lambda text: F.xxhash64(text.cast("string")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered over and within the files so that sources mix in proportion to the root of their size."""
    key, at = unused(docs, "mix_id"), unused(docs, "mix_at")
    slots = mixing.mix(spark, docs, most_sources=None).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "place")).alias(at))
    rows = docs.join(slots, docs["doc_id"].eqNullSafe(slots[key]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, F.col(f"{at}.slot")).sortWithinPartitions(f"{at}.slot", f"{at}.place").select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 ids, numbered so that sources mix over the sequences.

    The mixing position follows from ids and sources alone, so it is found again here: the order of rows in files is no input.
    """
    at = mixing.mix(spark, docs, most_sources=None).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("at"))
    at = at.select("doc_id", F.expr("at.slot * 32 + at.place").alias("at"))  # 32: the documents in a block
    return packing.pack_in_order(spark, docs, at, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("quality classifier", drop_bad),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Tokenizers and fitted models can't be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote for itself is deleted once its result is written; a stage's result, once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark) as own:
            docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            own.delete(before)
        before = own.paths[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
