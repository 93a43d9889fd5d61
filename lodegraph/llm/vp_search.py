"""Nearest neighbours by a vantage-point tree in each shard.

A bounded number of rows serve as pivots (a hash of the id draws them); every row belongs to the cell of its nearest pivot, and a cell
with many rows is dealt to several shards.  A task builds the tree of one shard: each node's vantage point parts its rows
at the median distance.  A query enters a child only if the triangle inequality allows a neighbour nearer than its k-th so
far there: bound * relax <= k-th distance.  relax 1 is exact; larger values skip more.  All queries of a part walk the tree
together, so each step is a matrix operation.

The same inequality routes queries to shards.  First each query visits the shards of its own cell, which gives it a k-th distance;
then only shards of cells that may hold something nearer, by the cell's distances from its pivot and by the plane between two pivots.
So work grows with queries times the cells near them, not with queries times shards, as far as the data have clusters; where
they have none, most cells are near.  Shards and parts of the queries have about shard_rows and part_rows rows, so a task's
memory is bounded; what is broadcast are pivots and cells, MOST_PIVOTS for each length of vector that was drawn.

Defined cases: vectors that are null, empty, zero or hold a null, a NaN or an infinity take no part; a query meets vectors
of its own length only; equal distances go to the smaller id; rows with the query's id are no candidates; rows that repeat a
query's id are queries of their own; fewer candidates than k give fewer rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import lowest, mark, small, written

LEAF = 64
#: Pivots for each length of vector, and about so many rows for each pivot at least.
MOST_PIVOTS, CELL_ROWS = 256, 500


class Tree:
    """Rows must come in order of id: of rows at equal distance the first k are kept."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed: int = 5):
        self.ids, self.points, self.rng = ids, points, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vp = int(rows[self.rng.integers(len(rows))])
        d = np.sqrt(((self.points[rows] - self.points[vp]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        children = []
        for part in (order[:half], order[half:]):
            children.append((d[part[0]], d[part[-1]], self._build(np.sort(rows[part]))))
        return vp, children

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, relax: float = 1.0, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), each len(queries) by k; infinity where there are fewer.  Beyond its limit a query looks for nothing."""
        self.limit = np.full(len(queries), np.inf) if limit is None else limit
        self.best = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)), ids, queries, k, relax)
        return self.best, self.who

    def _visit(self, node, active: np.ndarray, ids, queries, k: int, relax: float) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            d = np.sqrt(((queries[active][:, None, :] - self.points[node][None]) ** 2).sum(2))
            d[ids[active][:, None] == self.ids[node][None]] = np.inf
            d = np.concatenate([self.best[active], d], 1)
            who = np.concatenate([self.who[active], np.broadcast_to(self.ids[node], (len(active), len(node)))], 1)
            order = np.lexsort((who, d), axis=1)[:, :k]
            self.best[active], self.who[active] = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)
            return
        vp, children = node
        d = np.sqrt(((queries[active] - self.points[vp]) ** 2).sum(1))
        low = np.stack([np.maximum(d - hi, lo - d) for lo, hi, _ in children])
        first = (low[1] < low[0]).astype(int)
        for turn in (0, 1):
            for c in (0, 1):
                mine = first == c if turn == 0 else first != c
                # A little slack for rounding: a row at the k-th distance may still win by its id.
                open_ = mine & (low[c] * relax * (1 - 1e-9) <= np.minimum(self.best[active, k - 1], self.limit[active]))
                self._visit(children[c][2], active[open_], ids, queries, k, relax)


def _sound(column: Column) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def pivots_of(rows: DataFrame, n: int, most: int) -> dict[int, np.ndarray]:
    """The pivots by length of vector, from a sample of 2 * most different rows at most, in order of id."""
    wanted = max(1, min(most, n // CELL_ROWS))
    of_row = mark("vec_id", "v", 9)
    some = rows.filter(lowest(rows, of_row, 2 * wanted)).withColumn("mark", of_row).dropDuplicates(["mark"]).select("dim", "vec_id", "v").collect()
    out: dict[int, list] = {}
    for r in sorted(some, key=lambda r: (r.dim, r.vec_id, r.v)):
        out.setdefault(r.dim, []).append(r.v)
    return {dim: np.unique(np.array(v[:wanted], np.float64), axis=0) for dim, v in out.items()}


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None]) ** 2).sum(2))


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with vectors of one length, as a table and a matrix."""
    for batch in small(batches, 128):
        t = pa.table(batch)
        for dim in t["dim"].unique().to_pylist():
            some = t.filter(pa.compute.equal(t["dim"], dim)).combine_chunks()
            flat = some[column].combine_chunks().flatten()
            yield some, np.array(flat, dtype=np.float64).reshape(some.num_rows, dim)


def nearest(
    spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, relax: float = 1.0, shard_rows: int = 100_000,
    part_rows: int = 200_000, most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors(vec_id, embedding) that is_query marks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _sound(F.col("v"))).withColumn("dim", F.size("v"))
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    pivots = pivots_of(rows, rows.count(), most_pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, points in by_length(batches, "v"):
            d = distances(points, pivots[len(points[0])]) if len(points[0]) in pivots else np.zeros((len(points), 1))
            cell = d.argmin(1)
            out = t.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(d[np.arange(len(d)), cell]))
            yield from out.to_batches()

    schema = f"dim int, vec_id long, v array<{kind}>, q boolean, cell int, far double"
    placed = rows.select("dim", "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), F.coalesce("q", F.lit(False)).alias("q")).mapInArrow(place, schema)
    placed = written(placed.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # One row for each pivot.
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("q").alias("nq"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()
    sizes = [(r.dim, r.cell, math.ceil(r.n / shard_rows), max(1, math.ceil(r.nq / part_rows))) for r in cells]
    spread = F.broadcast(spark.createDataFrame(sizes, "dim int, cell int, subs int, parts int"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    dealt = lambda m: F.pmod(F.xxhash64("uid"), F.col(m)).cast("int")
    keys = ["dim", "cell", "sub", "part"]
    homes = placed.join(spread, ["dim", "cell"]).withColumn("sub", dealt("subs")).withColumn("part", every("parts")).select(*keys, "vec_id", "v")
    homes = homes.toDF(*homes.columns)  # columns of its own, as both sides of the cogroup come from one table

    def arrays(t):
        return t["vec_id"].to_numpy(), np.array(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)

    def search(home, guest):
        out = {"uid": [], "query_id": [], "vec_id": [], "score": []}
        if home.num_rows and guest.num_rows:
            tree = Tree(*arrays(home.sort_by("vec_id")))
            (ids, queries), uid, limit = arrays(guest), guest["uid"].to_numpy(), guest["most"].to_numpy()
            for i in range(0, len(ids), 1024):
                part = slice(i, i + 1024)
                d, who = tree.nearest(ids[part], queries[part], k, relax, limit[part])
                r, c = np.nonzero(np.isfinite(d))
                for name, v in zip(out, (uid[i + r], ids[i + r], who[r, c], d[r, c])):
                    out[name].append(v)
        kinds = {"uid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({x: pa.array(np.concatenate(v) if v else [], kinds[x]) for x, v in out.items()})

    def visit(guests: DataFrame) -> DataFrame:
        """What the shards of the guests' cells hold for them."""
        met = guests.join(spread, ["dim", "cell"]).withColumn("part", dealt("parts")).withColumn("sub", every("subs")).select(*keys, "vec_id", "v", "uid", "most")
        return homes.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(search, "uid long, query_id long, vec_id long, score double")

    asked = placed.filter("q").select("dim", "cell", "vec_id", "v", "uid")
    own = written(visit(asked.withColumn("most", F.lit(float("inf")))), "nearest-own")
    # At most k rows for each shard of a cell.
    kth = own.groupBy("uid").agg(F.sort_array(F.collect_list("score")).alias("s")).select("uid", F.expr(f"IF(size(s) >= {k}, s[{k - 1}], double('inf'))").alias("most"))
    bounds: dict[int, list] = {}
    for r in sorted(cells, key=lambda r: (r.dim, r.cell)):
        bounds.setdefault(r.dim, []).append((r.cell, r.lo, r.hi))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other cell that may hold something nearer than its k-th so far."""
        for t, points in by_length(batches, "v"):
            dim = len(points[0])
            if dim not in pivots:
                continue
            cell, lo, hi = (np.array(x) for x in zip(*bounds[dim]))
            d = distances(points, pivots[dim])
            least = np.maximum(np.maximum(d[:, cell] - hi, lo - d[:, cell]), (d[:, cell] - d.min(1, keepdims=True)) / 2)
            most = t["most"].to_numpy()
            r, c = np.nonzero((least * relax * (1 - 1e-9) <= most[:, None]) & (cell[None] != t["cell"].to_numpy()[:, None]))
            out = t.take(pa.array(r)).drop_columns(["cell"]).append_column("cell", pa.array(cell[c], pa.int32()))
            yield from out.select(["dim", "cell", "vec_id", "v", "uid", "most"]).to_batches()

    told = asked.join(kth, "uid", "left").withColumn("most", F.coalesce("most", F.lit(float("inf")))).select("dim", "cell", "vec_id", "v", "uid", "most")
    others = told.mapInArrow(route, f"dim int, cell int, vec_id long, v array<{kind}>, uid long, most double")
    found = own.union(visit(others))
    rank = F.row_number().over(W.partitionBy("uid").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
