"""Best-fit packing of documents into sequences by the linear grouping scheme.

Texts become ids plus an end id; only documents longer than a sequence are cut.  Then everything that decides where
a piece goes is a function of how many pieces there are of each length, a table of `limit` counts at most:

1. Pieces longer than limit * small are large.  In order of length they form groups of equal cardinality, and each
   length is rounded up to the largest of its group.
2. The configurations of the few rounded sizes are optimised as a linear programme by column generation (the new
   column is the best knapsack at the current prices) and rounded down.
3. The groups' actual lengths are put in the places of their rounded size.
4. Small pieces, and large ones that rounding down left over, go in order of length to the fullest sequence that has
   room, a new one if none has.

All of this handles equal sequences together, as (how many, contents), so its cost depends on the limit and not on the
number of documents.  Each piece then finds its place by its rank among the pieces of its length, in an equi-join
with the plan.  Ranks are counts over hash buckets plus a rank within the bucket: no length is a hot key.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import hash_bucket, small, written
from lodegraph.llm.tokens import encoder

RANK_BITS = 8
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]); row tells repeated ids apart."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in small(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                row = zlib.crc32(ids)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    values = (doc, row, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, v in zip(out, values):
                        column.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            n = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types)], names=names[:n])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def groups_of(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their counts, longest first, in groups of equal cardinality."""
    total, groups, seen = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = seen * n_groups // total
            room = -(-(g + 1) * total // n_groups) - seen
            while len(groups) <= g:
                groups.append([])
            take = min(left, max(1, room))
            groups[g].append((length, take))
            seen, left = seen + take, left - take
    return [g for g in groups if g]


def knapsack(sizes: np.ndarray, prices: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The configuration of at most limit // min(sizes) pieces with the largest sum of prices."""
    best, picks = np.zeros(limit + 1), []
    for _ in range(limit // int(sizes.min())):
        options = np.full((len(sizes), limit + 1), -1.0)
        for i, s in enumerate(sizes):
            options[i, s:] = best[: limit + 1 - s] + prices[i]
        pick = options.argmax(0)
        value = options[pick, np.arange(limit + 1)]
        better = value > best + 1e-12
        if not better[limit]:
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, value, best)
    config, room = np.zeros(len(sizes), dtype=int), limit
    for layer in reversed(picks):
        if layer[room] >= 0:
            config[layer[room]] += 1
            room -= sizes[layer[room]]
    return float(prices @ config), config


def configurations(sizes: np.ndarray, demand: np.ndarray, limit: int, steps: int = 600) -> list[tuple[int, np.ndarray]]:
    """(how often, configuration) from the linear programme, rounded down."""
    n = len(sizes)
    columns = np.diag(limit // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(steps):
        value, new = knapsack(sizes, np.maximum(inverse.sum(0), 0), limit)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ demand, inverse @ new
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = new
        try:
            inverse = np.linalg.inv(columns)
        except np.linalg.LinAlgError:
            break
    x = np.floor(inverse @ demand + 1e-6).astype(int)
    left, found = demand.astype(int).copy(), []
    for i in np.argsort(-x):
        config = columns[:, i].astype(int)
        fits = min(int(left[k] // config[k]) for k in range(n) if config[k])
        if (times := min(int(x[i]), fits)) > 0:
            left -= times * config
            found.append((times, config))
    return found


def substitute(groups: list[list[tuple[int, int]]], configs: list[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Sequences with actual lengths in the places of rounded ones, (how many, lengths), and what is left of the groups."""
    stock = [[list(x) for x in reversed(g)] for g in groups]
    made = []
    for times, config in configs:
        places = [g for g, n in enumerate(config) for _ in range(n)]
        streams = []
        for g in places:
            need, runs = times, []
            while need:
                length, n = stock[g][-1]
                take = min(n, need)
                runs.append([length, take])
                need -= take
                if take == n:
                    stock[g].pop()
                else:
                    stock[g][-1][1] -= take
            streams.append(runs[::-1])
        while streams and streams[0]:
            m = min(s[-1][1] for s in streams)
            made.append((m, [s[-1][0] for s in streams]))
            for s in streams:
                s[-1][1] -= m
                if not s[-1][1]:
                    s.pop()
    left: dict[int, int] = {}
    for g in stock:
        for length, n in g:
            left[length] = left.get(length, 0) + n
    return made, left


def best_fit(made: list[tuple[int, list[int]]], rest: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, pieces of it in each)])."""
    open_: dict[int, list] = {}
    gaps: list[int] = []

    def put(gap: int, m: int, content: list) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((m, content))

    for m, lengths in made:
        put(limit - sum(lengths), m, [(x, 1) for x in lengths])
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = limit // length
                if n >= each:
                    put(limit - each * length, n // each, [(length, each)])
                if n % each:
                    put(limit - n % each * length, 1, [(length, n % each)])
                break
            gap = gaps[at]
            m, content = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            each = gap // length
            full = min(m, n // each)
            if full:
                put(gap - each * length, full, [*content, (length, each)])
                n -= full * each
                m -= full
            if m and n and n < each:
                put(gap - n * length, 1, [*content, (length, n)])
                n, m = 0, m - 1
            if m:
                put(gap, m, content)
    return [x for gap in sorted(open_) for x in open_[gap]]


def plan(counts: dict[int, int], limit: int, small: float = 1 / 8, n_groups: int = 96) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, pieces in each sequence, first sequence, offset) for all pieces of each length."""
    large = {k: n for k, n in counts.items() if limit * small < k < limit}
    rest = {k: n for k, n in counts.items() if k <= limit * small}
    made: list[tuple[int, list[int]]] = [(counts[limit], [limit])] if counts.get(limit) else []
    if large:
        groups = groups_of(large, n_groups)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for g in groups:  # groups that round to the same size are one
            by_size.setdefault(g[0][0], []).extend(g)
        groups = list(by_size.values())
        sizes = np.array(list(by_size))
        demand = np.array([sum(n for _, n in g) for g in groups], dtype=float)
        put, left = substitute(groups, configurations(sizes, demand, limit))
        made += put
        rest |= left
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for m, content in best_fit(made, rest, limit):
        offset = 0
        for length, each in content:
            low = used.get(length, 0)
            used[length] = low + m * each
            rows.append((length, low, low + m * each, each, sequence, offset))
            offset += each * length
        sequence += m
    return rows


def place(spark: SparkSession, pieces: DataFrame, limit: int) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = pieces.withColumn("__bucket", hash_bucket("doc_id", RANK_BITS))
    by_bucket = written(pieces.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "pack-counts")
    # limit rows at most come to the driver, and the plan that goes back grows with limit alone.
    counts = {int(r.length): int(r.n) for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, limit)
    planned = spark.createDataFrame(rows, "__length long, __low long, __high long, __each long, __sequence long, __offset long")
    before = F.sum("n").over(W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = by_bucket.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    rank = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "row", "piece")) - 1
    ranked = pieces.withColumn("__rank", rank).join(starts, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__start"))
    met = F.expr("length = __length AND __rank >= __low AND __rank < __high")
    placed = ranked.join(F.broadcast(planned), met)
    return placed.withColumn("sequence_id", F.expr("__sequence + (__rank - __low) div __each")).withColumn(
        "offset", F.expr("__offset + (__rank - __low) % __each * length")
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    pieces = written(token_pieces(docs, tokenizer, end_id, limit), "pack-pieces")
    return place(spark, pieces, limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _ranked(rows: DataFrame, groups: list[str], by: str, ties: list[str], name: str) -> DataFrame:
    """rows with their rank, from 0, in the order of a number from 0 among those of a group: counts over ranges of it plus a rank within."""
    most = rows.agg(F.max(by).alias("__most"))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("__bucket", F.expr(f"cast({by} * {1 << RANK_BITS}D / (__most + 1) AS int)")).drop("__most")  # most: one row
    counts = rows.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*groups, "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy(*groups, "__bucket").orderBy(by, *ties)) - 1
    met = rows.withColumn("__within", within).join(starts, [*groups, "__bucket"])
    return met.withColumn(name, F.col("__start") + F.col("__within")).drop("__bucket", "__within", "__start")


def place_in_order(spark: SparkSession, pieces: DataFrame, limit: int) -> DataFrame:
    """pieces with sequence_id and offset, both following the pieces' order `at` as far as the plan's contents allow.

    Sequences of like contents are first spread evenly; each is then numbered by the place of its longest piece, and of each
    length the pieces in their order meet the plan's places for that length in the order of sequences.
    """
    # limit rows at most come to the driver, and the plan that goes back grows with limit alone.
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = spark.createDataFrame(plan(counts, limit), "length long, low long, high long, each long, first long, offset long")
    runs = planned.withColumn("m", F.expr("(high - low) div each")).withColumn("a", F.explode(F.expr("sequence(0L, m - 1, 65536L)")))
    runs = runs.withColumn("j", F.explode(F.expr("sequence(a, least(a + 65535, m - 1))")))
    spread = "cast((j + (first * 0.6180339887498949D) % 1) / m * 1000000000000D AS long)"
    places = runs.selectExpr("length", "first + j AS sequence", f"{spread} AS spread", "offset AS base", "explode(sequence(0L, each - 1)) AS k")
    places = written(places.selectExpr("length", "sequence", "spread", "base + k * length AS offset"), "pack-places")
    ranked = written(_ranked(pieces, ["length"], "at", ["doc_id", "row", "piece"], "rank"), "pack-ranks")
    first = _ranked(places, ["length"], "spread", ["sequence", "offset"], "rank").join(ranked.select("length", "rank", "at"), ["length", "rank"])
    longest = first.groupBy("sequence").agg(F.min(F.struct((-F.col("length")).alias("l"), "at")).alias("x")).select("sequence", F.col("x.at").alias("at"), F.lit(0).alias("all"))
    numbers = written(_ranked(longest, ["all"], "at", ["sequence"], "sequence_id").select("sequence", "sequence_id"), "pack-numbers")
    final = _ranked(places.join(numbers, "sequence"), ["length"], "sequence_id", ["offset"], "rank")
    return ranked.join(final.select("length", "rank", "sequence_id", "offset"), ["length", "rank"])


def pack_in_order(spark: SparkSession, docs: DataFrame, at: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """As pack; at: (doc_id, at), a number from 0 for each id, which places and sequences follow."""
    at = at.select(F.col("doc_id").cast("long").alias("__id"), F.col("at").cast("long").alias("at"))
    pieces = written(token_pieces(docs, tokenizer, end_id, limit), "pack-pieces")
    pieces = written(pieces.join(at, pieces["doc_id"].eqNullSafe(at["__id"])).drop("__id"), "pack-ordered")
    return place_in_order(spark, pieces, limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """(sequence_id, ids array<int>): the packed ids themselves; a sequence has `limit` ids at most."""
    pieces = written(token_pieces(docs, tokenizer, end_id, limit, with_ids=True), "pack-ids")

    def join(key, t):
        ids = b"".join(x for _, x in sorted(zip(t["offset"].to_pylist(), t["ids"].to_pylist())))
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [np.frombuffer(ids, "<u4").astype("i4")]})

    return place(spark, pieces, limit).groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>")
