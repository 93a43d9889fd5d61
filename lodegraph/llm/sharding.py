"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring; a row belongs to the first point clockwise of its id's hash, that is,
to that point's arc.  A shard takes no more than its bound of rows.  Rows that a full shard can't take go on
clockwise to the next shards, in rounds: in round h every arc offers what it has left to the h-th shard clockwise,
and a shard accepts in ring order until it is full.  The rounds need only the number of rows in each arc, so they run
on a table of shards * vnodes counts, whatever the input's size; each arc's rows, in hash order, are then cut
into the ranges that the rounds gave to each shard.  A row's rank in its arc is the number of rows in the cells of the ring before
its own, from a table of counts of fixed size, plus its rank in the cell: no task sorts a whole arc.

With overload 0 the bounds are the mean, rounded so that they add up to all rows: counts are at most one apart
(the law "rows").  A larger overload moves fewer rows when shards change.  Equal texts are not held together: a group of copies
may have a third of all rows, which no one of 16 shards may take under this law, and rows go by their ids.

Defined cases: a null text has size 1 and the checksum of no bytes; rows with a null id go by their texts;
rows that repeat count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RING = 1 << 32
#: The ring is cut into so many cells, so that finding the arc of a row is an equi-join with a table of fixed size.
CELLS = 16_384


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), ascending; points depend on the shard's number alone."""
    of = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big")
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(of(s, v), s)
    return sorted(points.items())


def arc_cells(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): arc i holds positions above point i-1 up to point i, the last wraps to arc 0."""
    width, rows, low = RING // CELLS, [], 0
    for arc, high in [(i, p) for i, (p, _) in enumerate(points)] + [(0, RING - 1)]:
        while low <= high:
            end = min(high, (low // width + 1) * width - 1)
            rows.append((low // width, low, end, arc))
            low = end + 1
    return rows


def bounded_rounds(counts: dict[int, int], points: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot) for the rows of every arc, ranks from 0."""
    n, room, taken, filled = len(points), list(bounds), {a: 0 for a in counts}, [0] * len(bounds)
    order = []
    for arc in range(n):  # the shards clockwise from each arc, each once
        if counts.get(arc):
            order.append((arc, list(dict.fromkeys(points[(arc + i) % n][1] for i in range(n)))))
    out = []
    for h in range(len(bounds)):
        for arc, shards in order:
            left = counts[arc] - taken[arc]
            if left and h < len(shards) and (take := min(left, room[shards[h]])):
                s = shards[h]
                out.append((arc, taken[arc], taken[arc] + take, s, filled[s]))
                taken[arc] += take
                room[s] -= take
                filled[s] += take
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, vnodes: int = 64, overload: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs."""
    points = ring_points(shards, vnodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))), 32).alias("at"),
    ).withColumn("cell", F.floor(F.col("at") / (RING // CELLS)).cast("int"))
    # All tables that are broadcast have sizes set by shards, vnodes and CELLS.
    cells = spark.createDataFrame(arc_cells(points), "cell int, low long, high long, arc int")
    placed = rows.join(F.broadcast(cells), (rows.cell == cells.cell) & (rows.at >= cells.low) & (rows.at <= cells.high)).select(
        "doc_id", "size", "text_crc32", "at", "arc", rows.cell
    )
    counts, before = {}, []
    # CELLS + shards * vnodes rows at most.
    for r in sorted(placed.groupBy("arc", "cell").count().collect(), key=lambda r: (r.arc, r.cell)):
        before.append((r.arc, r.cell, counts.get(r.arc, 0)))
        counts[r.arc] = counts.get(r.arc, 0) + r["count"]
    n = sum(counts.values())
    each = [n // shards + (s < n % shards) for s in range(shards)]
    bounds = [b + int(overload * b) for b in each]
    cuts = spark.createDataFrame(bounded_rounds(counts, points, bounds), "arc int, low long, high long, shard int, base long")
    starts = spark.createDataFrame(before, "arc int, cell int, start long")
    rank = F.row_number().over(W.partitionBy("arc", "cell").orderBy("at", "doc_id", "size", "text_crc32")) - 1
    ranked = placed.withColumn("rank", rank).join(F.broadcast(starts), ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("start"))
    met = (ranked.arc == cuts.arc) & (ranked["rank"] >= cuts.low) & (ranked["rank"] < cuts.high)
    return ranked.join(F.broadcast(cuts), met).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("low")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
