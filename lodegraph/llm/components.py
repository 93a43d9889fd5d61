"""Connected components of an edge list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import written

#: So many edges at most are joined up inside one task.
TASK_EDGES = 400_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: (v, smallest vertex that they connect it to)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        r = v
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[v] != r:
            parent[v], v = r, parent[v]
        return r

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(v, r) for v in list(parent) if (r := root(v)) != v]
    for i in range(0, len(found), 50_000):
        part = found[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], names=["v", "comp"])


def _least(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star: neighbours move to the smallest vertex next to them."""
    both = edges.union(edges.select("comp", "v"))
    least = both.groupBy("v").agg(F.min("comp").alias("m")).select("v", F.least("v", "m").alias("m"))
    large = both.filter("comp > v").join(least, "v").select(F.col("comp").alias("v"), F.col("m").alias("comp")).filter("v <> comp")
    down = large.select(F.greatest("v", "comp").alias("v"), F.least("v", "comp").alias("comp")).distinct()
    least = down.groupBy("v").agg(F.min("comp").alias("m"))
    small = down.join(least, "v")
    return small.select(F.col("comp").alias("v"), F.col("m").alias("comp")).union(small.select("v", "m")).filter("v <> comp").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): for every vertex but the smallest of each component, that smallest vertex.

    Partitions of TASK_EDGES edges are first joined up on their own; what they leave is contracted by star rounds, each
    of them written, until nothing changes.
    """
    edges = written(edges.toDF("v", "comp").filter("v <> comp"), "edges")
    parts = max(1, math.ceil(edges.count() / TASK_EDGES))
    now = written(edges.repartition(parts).mapInArrow(_stars, "v long, comp long"), "stars")
    mark = None
    while parts > 1:
        now = written(_least(now), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "comp").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now
