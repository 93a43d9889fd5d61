"""Pfair mixing, the consistent-hash ring and vantage-point search."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import mixing, sharding, vp_search


@pytest.mark.parametrize("name,weights", [("docs", None), ("docs", {"web": 5, "books": 2, "code": 3}), ("edge", None), ("none", None)])
def test_mix(spark, request, name, weights):
    table = request.getfixturevalue(name)
    size = 4
    rows = mixing.mix(spark, table, weights, block_docs=size).collect()
    assert sorted((repr(r.doc_id), repr(r.source)) for r in rows) == sorted((repr(r.doc_id), repr(r.source)) for r in table.select("doc_id", "source").collect())
    slots = defaultdict(list)
    for r in rows:
        assert r.release_slot <= r.slot < r.deadline_slot
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    n = Counter(r.source for r in rows)
    blocks = {s: -(-k // size) for s, k in n.items()}
    weight = {r.source: r.weight for r in rows}
    for held in slots.values():
        assert len({(r.source, r.block) for r in held}) == 1
        assert sorted(r.place for r in held) == list(range(len(held)))
    # As long as no source runs out, every source is less than one block from its share.
    given, total = Counter(), sum(weight.values())
    whole = min((blocks[s] // weight[s] for s in blocks), default=0)
    for t in range(whole * total):
        given[slots[t][0].source] += 1
        for s in weight:
            assert abs(given[s] - (t + 1) * weight[s] / total) < 1
    # Blocks of a source come in order.
    last = Counter()
    for t in range(len(slots)):
        s = slots[t][0].source
        assert slots[t][0].block == last[s]
        last[s] += 1


def plain_schedule(n, weight, size):
    """Slot by slot and without rounds: (source, block) of each, released blocks with the earliest deadline first, the first source of several."""
    names = sorted(n, key=lambda s: (s is not None, s or ""))
    blocks = {s: -(-n[s] // size) for s in names}
    # All slots passed when source s has i blocks, times its weight.
    at = lambda i, s: sum(min(blocks[j] * weight[s], weight[j] * i) for j in names)
    jobs = sorted((at(i, s) // weight[s], -(-at(i + 1, s) // weight[s]), k, s, i) for k, s in enumerate(names) for i in range(blocks[s]))
    queue, out = [], []
    for t in range(len(jobs)):
        while jobs and jobs[0][0] <= t:
            heapq.heappush(queue, jobs.pop(0)[1:])
        due, _, s, i = heapq.heappop(queue)
        assert t < due
        out.append((s, i))
    return out


@pytest.mark.parametrize("name,weights", [("docs", None), ("docs", {"web": 5, "books": 2, "code": 3}), ("edge", None), ("none", None)])
def test_mix_slot_by_slot(spark, request, name, weights):
    rows = mixing.mix(spark, request.getfixturevalue(name), weights, block_docs=4).collect()
    n = Counter(r.source for r in rows)
    roots = sum(v**0.5 for v in n.values())
    told = {s: (weights.get(s, 1) if weights else max(1, round(n[s] ** 0.5 * max(256, 32 * len(n)) / roots))) for s in n}
    assert {r.source: r.weight for r in rows} == told
    got = {r.slot: (r.source, r.block) for r in rows}
    assert [got[t] for t in sorted(got)] == plain_schedule(n, told, 4)


def test_mix_sources_limit(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark, rows)


def test_mix_any_number_of_sources(spark):
    sizes = {f"site{i}": 1 + i % 3 for i in range(400)} | {"hot": 900, "warm": 300}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 90, "warm": 30}
    got = mixing.mix(spark, table, weights, block_docs=2, most_sources=None).collect()
    assert sorted((r.doc_id, r.source) for r in got) == rows
    slots = {}
    for r in got:
        assert r.release_slot <= r.slot < r.deadline_slot
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(sum(-(-n // 2) for n in sizes.values())))
    given, total = Counter(), 400 + 90 + 30
    for t in range(total):
        given[slots[t][0]] += 1
        assert all(abs(given[s] - (t + 1) * weights.get(s, 1) / total) < 1 for s in sizes)


@pytest.mark.parametrize("sizes", [[40000] + [80] * 1000, [10**7 // (i + 1) for i in range(10000)]])
def test_weights_keep_their_targets_with_many_sources(spark, sizes):
    counts = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "key string, n long")
    weight = {int(r.key): r.weight for r in mixing.temper(counts).collect()}
    roots, total = sum(n**0.5 for n in sizes), sum(weight.values())
    for i, n in enumerate(sizes):
        want = n**0.5 / roots
        assert abs(weight[i] / total - want) <= want / 32 + 1 / total


def test_many_sources_get_their_shares_at_every_slot(spark):
    sizes = {"hot": 4000} | {f"site{i}": 8 + i % 3 for i in range(1000)}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    rows = mixing.mix(spark, table, block_docs=4, most_sources=None).select("slot", "source", "block", "weight").distinct().collect()
    weight, got = {r.source: r.weight for r in rows}, {r.slot: (r.source, r.block) for r in rows}
    order = [got[t] for t in sorted(got)]
    assert order == plain_schedule(sizes, weight, 4)
    # Until the first small source runs out, the hot one has its share to within one block.
    share, first = weight["hot"] / sum(weight.values()), next(t for t, (s, b) in enumerate(order) if s != "hot" and b == 1)
    roots = sum(n**0.5 for n in sizes.values())
    assert share == pytest.approx(sizes["hot"] ** 0.5 / roots, rel=1 / 32)
    for t in range(first):
        assert abs(sum(s == "hot" for s, _ in order[: t + 1]) - share * (t + 1)) < 1


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_both_ways_to_mix_agree(spark, request, name):
    table = request.getfixturevalue(name)
    a, b = (sorted(repr(r) for r in mixing.mix(spark, table, None, 4, array_sources=n).collect()) for n in (256, 0))
    assert a == b


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_shards(spark, request, name):
    table = request.getfixturevalue(name)
    rows = sharding.shard(spark, table).collect()
    want = sorted((repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.select("doc_id", "text").collect())
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def plain_ring(rows, shards, vnodes, overload):
    """Row by row: every row's point, then rounds in which each shard clockwise takes rows of an arc until it is full."""
    import bisect
    import hashlib
    import struct
    import zlib

    import xxhash

    h64 = lambda b: xxhash.xxh64_intdigest(b, 42)
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big"), s)
    at = sorted(points)
    arcs = [[] for _ in at]
    for i, t in rows:
        raw = (t or "").encode()
        key = struct.pack("<q", i) if i is not None else struct.pack("<Q", h64(raw))
        where = h64(key) >> 32
        arcs[bisect.bisect_left(at, where) % len(at)].append((where, (i is not None, i or 0), len(raw) + 1, zlib.crc32(raw), i))
    for a in arcs:
        a.sort()
    n = len(rows)
    room = [(m := n // shards + (s < n % shards)) + int(overload * m) for s in range(shards)]
    out, slots = [], [0] * shards
    turns = [list(dict.fromkeys(points[at[(a + k) % len(at)]] for k in range(len(at)))) for a in range(len(at))]
    for turn in range(shards):
        for a, rest in enumerate(arcs):
            s = turns[a][turn]
            while rest and room[s]:
                _, _, size, crc, i = rest.pop(0)
                out.append((i, size, crc, s, slots[s]))
                slots[s] += 1
                room[s] -= 1
    return out


@pytest.mark.parametrize("overload", [0.0, 0.25])
@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_shards_by_a_plain_ring(spark, request, name, overload):
    table = request.getfixturevalue(name)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(spark, table, vnodes=8, overload=overload).collect()]
    want = plain_ring([(r.doc_id, r.text) for r in table.collect()], 16, 8, overload)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_more_shard_moves_few(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = lambda n: {r.doc_id: r.shard for r in sharding.shard(spark, rows, shards=n, overload=0.25).collect()}
    old, new = at(16), at(17)
    assert sum(old[d] != new[d] for d in old) < 0.35 * len(old)


def brute_nearest(vectors, k):
    sound = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in sound.items():
        if q % 100:
            continue
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in sound.items() if i != q and len(w) == len(v))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").union(
        spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id + 1000", "embedding", "label"))
    got = sorted(tuple(r) for r in vp_search.nearest(spark, table, F.col("vec_id") % 100 == 0, shard_rows=150).collect())
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_nearest_with_bad_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.0, 0.0, 0.0]), (503, [1.0, None, 1.0]), (504, [float("nan"), 1.0, 1.0]), (505, [float("inf"), 1.0, 1.0]),
             (600, [1.0, 2.0]), (601, [1.0, 2.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("v", F.lit(0))
    got = sorted(tuple(r) for r in vp_search.nearest(spark, table, F.col("vec_id") % 100 == 0).collect())
    want = brute_nearest(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert vp_search.nearest(spark, table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_queries_visit_near_cells_alone(spark, monkeypatch):
    """Clustered rows: few cells are near a query, the result is still exact, also where shards and parts are several."""
    monkeypatch.setattr(vp_search, "CELL_ROWS", 20)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.2]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 10)
    for sizes in ({}, {"shard_rows": 30, "part_rows": 2}):
        got = sorted(tuple(r) for r in vp_search.nearest(spark, table, F.col("vec_id") % 100 == 0, **sizes).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 4
    points = centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    tree, ids = vp_search.Tree(np.arange(4000), points), np.arange(0, 4000, 100)
    exact = tree.nearest(ids, points[ids], 10)[1]
    near = tree.nearest(ids, points[ids], 10, relax=1.3)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, near)]) >= 0.9


def test_pivots_of_repeated_ids_are_bounded(spark):
    for v in ("array(cast(id AS double), 1.0D)", "array(3.0D, 1.0D)"):
        rows = spark.range(30_000).selectExpr("7L AS vec_id", f"{v} AS v", "2 AS dim")
        found = vp_search.pivots_of(rows, 30_000, 8)
        assert 1 <= len(found[2]) <= 8
