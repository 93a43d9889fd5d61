"""Event streams: topics, rates, debouncing, percentiles, deduplication.  Each operator works on batch and streaming frames
unless its name says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid_topic(topic: Column) -> Column:
    """Dotted segments, none empty, without white space or control characters."""
    return topic.rlike(r"^[^.\s\p{Cntrl}]+(\.[^.\s\p{Cntrl}]+)*$")


def topic_pattern(pattern: str) -> str:
    """* is one segment; # at the end is one or more; # alone is any topic."""
    if pattern == "#":
        return "^.+$"
    parts = pattern.split(".")
    out = [r"[^.]+(?:\.[^.]+)*" if p == "#" and i == len(parts) - 1 else r"[^.]+" if p == "*" else re.escape(p) for i, p in enumerate(parts)]
    return "^" + r"\.".join(out) + "$"


def subscribed(events: DataFrame, pattern: str, topic: str = "topic") -> DataFrame:
    return events.filter(F.col(topic).rlike(topic_pattern(pattern)))


def decode(events: DataFrame, payload: str, schemas: dict[str, T.StructType | str], kind: str) -> DataFrame:
    """Each kind's fields of a JSON payload in a column of the kind's name; other kinds stay raw."""
    out = events
    for name, schema in schemas.items():
        out = out.withColumn(name, F.when(F.col(kind) == name, F.from_json(payload, schema)))
    return out


def rates(events: DataFrame, ts: str, width: str, seconds: float, *keys: str, late: str | None = None) -> DataFrame:
    """(start, keys, n, per_second) in tumbling windows; late: the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    met = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return met.select(F.col("w.start").alias("start"), *keys, "n", (F.col("n") / seconds).alias("per_second"))


def debounce(events: DataFrame, key: str, ts: str, kind: str, quiet: str = "250 milliseconds", delete: str = "delete") -> DataFrame:
    """Batch: one row for each burst of a key that `quiet` without events ends; a delete in the burst wins.

    (key, first, last, n, kind)
    """
    w = W.partitionBy(key).orderBy(ts)
    gap = F.coalesce(F.col(ts) - F.lag(ts).over(w) >= F.expr(f"INTERVAL {quiet}"), F.lit(True))
    runs = events.withColumn("__new", gap.cast("int")).withColumn("__burst", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    deleted = F.bool_or(F.col(kind) == delete)
    return runs.groupBy(key, "__burst").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"), F.when(deleted, F.lit(delete)).otherwise(F.max_by(kind, ts)).alias("kind")
    ).drop("__burst")


def debounce_stream(events: DataFrame, key: str, ts: str, kind: str, quiet: str = "250 milliseconds", late: str = "1 second", delete: str = "delete") -> DataFrame:
    """Stream: the same by session windows, emitted once the watermark has passed a burst."""
    met = events.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("w"), key)
    met = met.agg(F.count("*").alias("n"), F.bool_or(F.col(kind) == delete).alias("gone"), F.max_by(kind, ts).alias("last_kind"))
    return met.select(key, F.col("w.start").alias("first"), "n", F.when(F.col("gone"), F.lit(delete)).otherwise(F.col("last_kind")).alias("kind"))


def tail(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Batch: the last n rows of each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each event once, with state no older than the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def changed_only(files: DataFrame, known: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """Files whose digest is not the known one."""
    return files.join(known.select(key, digest), [key, digest], "left_anti")


def upsert_each(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Write each micro-batch's rows as a new version of their keys under path; readers take the latest version."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch)).write.mode("append").partitionBy("version").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def latest_version(rows: DataFrame, key: str) -> DataFrame:
    rank = F.dense_rank().over(W.partitionBy(key).orderBy(F.desc("version")))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def upsert_newest(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """Write all that the stream holds now, of each micro-batch the newest row of each key; a started query that ends by itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        newest.withColumn("version", F.lit(epoch)).write.mode("append").partitionBy("version").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def evicted(sends: DataFrame, consumer: str, order: str, full: str, limit: int = 256) -> DataFrame:
    """(consumer, evicted_at): where a consumer's queue was full at `limit` sends in a row for the first time."""
    w = W.partitionBy(consumer).orderBy(order)
    rows = sends.withColumn("__free", F.sum(F.when(F.col(full), 0).otherwise(1)).over(w))
    run = F.row_number().over(W.partitionBy(consumer, "__free").orderBy(order))
    late = rows.filter(F.col(full)).withColumn("__run", run).filter(F.col("__run") == limit)
    return late.groupBy(consumer).agg(F.min(order).alias("evicted_at"))
