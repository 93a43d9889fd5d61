"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source's documents, in hash order, form blocks of `block_docs`.  Target weights are whole numbers W; in a round each source
gets W blocks as long as it has so many.  Let S(v) = the sum over sources of min(blocks, W * v) be the slots that have passed
when every source was served in proportion to its weight for v rounds.  A source's block i is released at floor(S(i / W)) and due
at ceil(S((i + 1) / W)); in every slot the released block with the earliest deadline goes first (ties: the source that sorts
first).  All blocks meet their deadlines then, so every source is less than one block from its target at every slot, and exactly
on it between rounds.  Every document gets a slot: from the moment a source runs out, the others share its slots.

Weights made from sizes are whole numbers of about 32 a source in sum (256 at least), and 1 at least, so a source's share is at
most one part in 32 below its target, besides the rounding of its own weight by half.

At the end of a round all sources have whole blocks, so rounds are scheduled each by itself.  Rounds with the same blocks have the
same order, and there are at most 2k + 1 different ones for k sources, so the scheduling is done once for each of those, on
tables whose size k and the sum of the weights bound.  Ranks within a source are counts over hash buckets plus a rank within the
bucket, so a source with a third of all rows is no hot key.

Defined cases: a null source is a source of its own; a null id is an id like others; repeated rows count each; an empty
table gives an empty result; extra columns are ignored.  Up to MAX_SOURCES sources the rounds are made by Spark's array
functions, beyond that by a heap in a Python worker, one round at a time and to the same order; their slots are at most as
many as there are blocks.  `most_sources` sets a number beyond which mixing is an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import hash_bucket, written

MAX_SOURCES = 256
RANK_BITS = 10

#: Of each source s of a round with weights w and blocks m, w[s] * S(i / w[s]) for i up to m[s].
EDGES = """
transform(sequence(0, size(m) - 1), s -> transform(sequence(0, m[s]), i ->
  aggregate(sequence(0, size(m) - 1), 0L, (x, j) -> x + least(m[j] * w[s], w[j] * i))))
"""

#: One round: in each slot t, of the sources with a released block, the one whose block is due first.
ROUND = """
aggregate(
  sequence(0, slots - 1),
  named_struct('given', array_repeat(0, size(m)),
               'order', cast(array() as array<struct<src: int, nth: int, release: int, deadline: int>>)),
  (st, t) -> transform(array(array_min(transform(
      filter(sequence(0, size(m) - 1), s -> st.given[s] < m[s] and edges[s][st.given[s]] div w[s] <= t),
      s -> named_struct('deadline', cast((edges[s][st.given[s] + 1] + w[s] - 1) div w[s] as int), 'src', s,
                        'release', cast(edges[s][st.given[s]] div w[s] as int))))),
    p -> named_struct('given', transform(st.given, (g, s) -> if(s = p.src, g + 1, g)),
                      'order', concat(st.order, array(named_struct('src', p.src, 'nth', st.given[p.src],
                                                                   'release', p.release, 'deadline', p.deadline)))))[0],
  st -> st.order)
"""


def _key(column: str = "source"):
    return F.concat(F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(column).cast("string"), F.lit("")))


def temper(counts: DataFrame, quanta: int = 256, power: float = 0.5, per_source: int = 32) -> DataFrame:
    """Target weights in proportion to a power of each source's size: (key, n, weight), weights of about quanta, or per_source for each source, in sum."""
    share, all_ = F.pow("n", F.lit(power)), W.partitionBy(F.lit(0))
    quanta = F.greatest(F.lit(quanta), F.lit(per_source) * F.count("*").over(all_))
    return counts.select("key", "n", F.greatest(F.lit(1), F.round(share * quanta / F.sum(share).over(all_))).cast("int").alias("weight"))


def templates(sources: DataFrame, block_docs: int) -> DataFrame:
    """(from_round, to_round, base, slots, src, nth, t, release, deadline): the order of each kind of round.  base: the first slot of from_round."""
    one = sources.select("key", "weight", F.ceil(F.col("n") / block_docs).cast("long").alias("blocks"))
    one = one.agg(F.sort_array(F.collect_list(F.struct("key", "weight", "blocks"))).alias("srcs")).filter(F.size("srcs") > 0)
    ends = "array_sort(array_distinct(flatten(transform(srcs, s -> array(0L, s.blocks div s.weight, s.blocks div s.weight + 1)))))"
    kinds = one.select("srcs", F.expr(ends).alias("ends")).select(
        "srcs", F.explode(F.expr("transform(sequence(1, size(ends) - 1), i -> named_struct('a', ends[i - 1], 'b', ends[i]))")).alias("r")
    )
    kinds = kinds.selectExpr(
        "r.a AS from_round",
        "r.b AS to_round",
        "transform(srcs, s -> cast(greatest(0L, least(s.weight, s.blocks - r.a * s.weight)) AS int)) AS m",
        "transform(srcs, s -> cast(s.weight AS long)) AS w",
        "aggregate(srcs, 0L, (x, s) -> x + least(s.blocks, r.a * s.weight)) AS base",
    ).withColumn("slots", F.expr("aggregate(m, 0, (x, y) -> x + y)"))
    kinds = kinds.filter("slots > 0").repartition("from_round").withColumn("edges", F.expr(EDGES))
    order = kinds.select("from_round", "to_round", "base", "slots", F.posexplode(F.expr(ROUND)).alias("t", "o"))
    return order.select("from_round", "to_round", "base", "slots", "o.src", "o.nth", "t", "o.release", "o.deadline")


def round_order(m: np.ndarray, w: np.ndarray) -> list[tuple[int, int, int, int]]:
    """One round as in ROUND, of m[s] blocks of each source s with weight w[s]: (s, nth, release, deadline) slot by slot."""
    slots = int(m.sum())
    src = np.repeat(np.arange(len(m)), m)
    nth = np.arange(slots) - np.repeat(np.cumsum(m) - m, m)
    ends = np.argsort(m / w)
    done, rate = np.append(0, np.cumsum(m[ends])), w.sum() - np.append(0, np.cumsum(w[ends]))

    def edge(i: np.ndarray) -> np.ndarray:
        past = np.searchsorted((m / w)[ends], i / w[src])
        return w[src] * done[past] + i * rate[past]

    release, deadline = edge(nth) // w[src], -(-edge(nth + 1) // w[src])
    by = np.argsort(release, kind="stable")
    queue, out, k = [], [], 0
    for t in range(slots):
        while k < slots and release[by[k]] <= t:
            heapq.heappush(queue, (int(deadline[by[k]]), int(src[by[k]]), int(by[k])))
            k += 1
        due, s, i = heapq.heappop(queue)
        out.append((s, int(nth[i]), int(release[i]), due))
    return out


def schedule(sources: DataFrame, block_docs: int) -> DataFrame:
    """(src, block, slot, release_slot, deadline_slot) of every block, for any number of sources (src, n, weight)."""
    one = sources.select("src", F.col("weight").cast("long").alias("weight"), F.ceil(F.col("n") / block_docs).cast("long").alias("blocks"))
    one = written(one.withColumn("full", F.expr("blocks div weight")), "mix-blocks")
    ends = one.select(F.explode(F.array(F.lit(0).cast("long"), F.col("full"), F.col("full") + 1)).alias("a")).distinct()
    # Sources that run out in d different rounds have d * (d - 1) / 2 blocks at least: there are few ends, and few sums over them.
    kinds = ends.withColumn("b", F.lead("a").over(W.partitionBy(F.lit(0)).orderBy("a"))).filter("b IS NOT NULL")
    listed = kinds.agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("kinds"))
    live = one.crossJoin(F.broadcast(listed)).select("src", "weight", "blocks", F.explode(F.expr("filter(kinds, r -> r.a * weight < blocks)")).alias("r"))
    live = live.selectExpr("r.a AS a", "r.b AS b", "src", "weight", "least(weight, blocks - r.a * weight) AS m")
    sums = live.groupBy("a", "b").agg(F.sum("m").alias("slots"))
    before = F.sum(F.expr("(b - a) * slots")).over(W.partitionBy(F.lit(0)).orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    sums = written(sums.withColumn("base", F.coalesce(before, F.lit(0))), "mix-rounds")

    def ordered(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("src", ignore_index=True)
        found = np.array(round_order(t["m"].to_numpy("int64"), t["weight"].to_numpy("int64")), "int64").reshape(-1, 4)
        s = found[:, 0]
        columns = {"a": t["a"][s], "src": t["src"][s], "weight": t["weight"][s]}
        out = {k: v.to_numpy("int64") for k, v in columns.items()} | {"nth": found[:, 1], "t": np.arange(len(s)), "release": found[:, 2], "deadline": found[:, 3]}
        return pd.DataFrame(out)

    names = "a long, src long, weight long, nth long, t long, release long, deadline long"
    rounds = live.groupBy("a").applyInPandas(ordered, names).join(sums, "a")
    rounds = rounds.withColumn("round", F.explode(F.expr("sequence(a, b - 1)"))).withColumn("first", F.expr("base + (round - a) * slots"))
    return rounds.selectExpr("src", "round * weight + nth AS block", "first + t AS slot", "first + release AS release_slot", "first + deadline AS deadline_slot")


def mix(
    spark: SparkSession, docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = 32,
    most_sources: int | None = MAX_SOURCES, array_sources: int = MAX_SOURCES,
) -> DataFrame:
    """(doc_id, source, weight, block, release_slot, deadline_slot, slot, place): read by (slot, place), the rows are mixed.

    weights: whole numbers by source, 1 for those not named; None: in proportion to the square root of a source's size.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), _key().alias("key"))
    rows = rows.withColumn("bucket", hash_bucket("doc_id", RANK_BITS)).withColumn("h", F.xxhash64("doc_id", F.lit(1)))
    by_bucket = written(rows.groupBy("key", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    counts = by_bucket.groupBy("key").agg(F.sum("n").alias("n"))
    if (k := counts.count()) > (k if most_sources is None else most_sources):
        raise ValueError(f"{k} sources; at most {most_sources} can be mixed")
    if weights is None:
        weighted = temper(counts)
    else:
        told = F.lit(1)
        for name, w in weights.items():
            told = F.when(F.col("key") == "1" + name, F.lit(int(w))).otherwise(told)
        weighted = counts.withColumn("weight", told)
    listed = weighted.withColumn("src", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("key")) - 1).select("key", "src", "weight", "n")
    if k > array_sources:
        listed = written(listed.withColumn("src", F.col("src").cast("long")), "mix-sources")

    before = F.sum("n").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = by_bucket.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    if k > array_sources:
        starts = starts.join(listed.drop("n"), "key")
    within = F.row_number().over(W.partitionBy("key", "bucket").orderBy("h", "doc_id")) - 1
    ranked = rows.withColumn("within", within).join(starts, ["key", "bucket"])
    if k > array_sources:
        at = "(start + within)"
        blocks = ranked.selectExpr("doc_id", "source", "src", "weight", f"{at} div {block_docs} AS block", f"cast({at} % {block_docs} AS int) AS place")
        met = blocks.join(schedule(listed, block_docs), ["src", "block"])
        return met.select("doc_id", "source", "weight", "block", "release_slot", "deadline_slot", "slot", "place")
    order = written(templates(weighted, block_docs), "mix-order")
    # listed has a row for each source, order 2 * MAX_SOURCES + 1 rounds at most: both may be broadcast.
    blocks = ranked.withColumn("rank", F.col("start") + F.col("within")).join(F.broadcast(listed.drop("n")), "key")
    blocks = blocks.selectExpr(
        "doc_id", "source", "src", "weight", f"rank div {block_docs} AS block", f"cast(rank % {block_docs} AS int) AS place"
    ).selectExpr("*", "block div weight AS round", "cast(block % weight AS int) AS nth")
    order = order.withColumnsRenamed({"src": "o_src", "nth": "o_nth"})
    met = "src = o_src AND nth = o_nth AND round >= from_round AND round < to_round"
    first = "base + (round - from_round) * slots"
    return blocks.join(F.broadcast(order), F.expr(met)).selectExpr(
        "doc_id", "source", "weight", "block", f"{first} + release AS release_slot", f"{first} + deadline AS deadline_slot",
        f"{first} + t AS slot", "place",
    )
