"""Exact dedup, n-gram Jaccard join and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodegraph.llm import exact_dedup, ngram_join, substring_dedup
from lodegraph.llm.components import components
from lodegraph.llm.fm_index import repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def brute_exact(pairs, best=max):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = best([i for i in ids if i is not None], default=None)
        seen = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen = seen or i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_exact_dedup(spark, request, name):
    table = request.getfixturevalue(name)
    got = rows_of(exact_dedup.exact_dedup(spark, table, least_memtables=5), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(pairs_of(table))


def test_exact_dedup_smallest(spark, docs):
    got = rows_of(exact_dedup.exact_dedup(spark, docs, keep="smallest"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(pairs_of(docs), min)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_an_index_absorbs_later_documents(spark, docs, edge, keep):
    both = docs.select("doc_id", "text").union(edge.select("doc_id", "text"))
    early, late = both.filter("doc_id % 3 = 0"), both.filter("doc_id % 3 <> 0 OR doc_id IS NULL")
    index = exact_dedup.compact(exact_dedup.memtable_runs(early, 40, 3), keep)
    got = rows_of(exact_dedup.absorb(index, late, keep, 40, 3), "digest", "keep_id", "group_size")
    assert got == rows_of(exact_dedup.compact(exact_dedup.memtable_runs(both, 40, 3), keep), "digest", "keep_id", "group_size")
    assert rows_of(exact_dedup.absorb(index, late.limit(0), keep), "digest") == rows_of(index, "digest")


def test_exact_dedup_sql(spark, duck, docs):
    got = exact_dedup.exact_dedup(spark, docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.execute(exact_dedup.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))


def shingle_set(text, n=5):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_jaccard(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    parent = {i: i for i, _ in pairs if i is not None}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted([(i, len(s), None if i is None else root(i)) for i, s in sets], key=repr)


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_jaccard_components(spark, request, name):
    table = request.getfixturevalue(name)
    got = rows_of(ngram_join.jaccard_components(spark, table), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard(pairs_of(table))


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_jaccard_of_ids_with_several_texts(spark, order):
    """The links of each of an id's texts count, in whatever order its rows come."""
    base = [f"w{k}" for k in range(40)]
    more = [f"m{k}" for k in range(400)]
    odd = [(5, " ".join(base)), (5, " ".join(base + more)), (9, " ".join(base[:-1] + ["other"]))]
    rest = [(20 + k, " ".join(more + [f"t{k}_{i}" for i in range(300)])) for k in range(6)]
    rest += [(12, " ".join(more + base)), (9, None), (30, ""), (31, " ".join(base[1:])), (31, "of its own")]
    pairs = [odd[k] for k in order] + rest
    table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = rows_of(ngram_join.jaccard_components(spark, table), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard(pairs)
    assert {c for i, _, c in got if i in (5, 9, 31)} == {5}


def near_copies(n, groups, seed):
    """Groups of texts that differ in a few words each, so that their shingles are shared by many."""
    rng = np.random.default_rng(seed)
    base = [[f"g{g}w{w}" for w in rng.integers(0, 10_000, 60)] for g in range(groups)]
    out = []
    for i in range(n):
        words = list(base[i % groups])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 60))] = f"x{rng.integers(0, 50)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_jaccard_with_hot_shingles(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    pairs = near_copies(240, 3, 1)
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    got = rows_of(ngram_join.jaccard_components(spark, table), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard(pairs)


def joined_rows(df):
    """The most rows that a join of df's plan made, once df has run."""
    def walk(plan):
        if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.finalPhysicalPlan()
        if "QueryStage" in plan.nodeName():
            plan = plan.plan()
        made = plan.metrics().get("numOutputRows") if "Join" in plan.nodeName() else None
        return max([made.get().value() if made is not None and made.isDefined() else 0, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_unlike_members_of_a_hot_shingle_meet_only_where_filters_pass(spark):
    """A family shares hot shingles; members with many shingles of their own have these late in their prefixes, and meet nobody."""
    members = [(g, b"%04d" % i, 100, 15 + g if i % 2 else 5 + g, i, ["a%d" % i, "b%d" % i]) for i in range(600) for g in range(4)]
    hot = spark.createDataFrame(members, "gram long, cls binary, n int, pos int, v long, blocks array<string>")
    comps = spark.createDataFrame([(i, 0) for i in range(2, 600, 2)], "v long, comp long")
    cold = spark.createDataFrame([], "a binary, b binary, open boolean, shared long")
    rest = ngram_join._rest(hot, comps, cold, 4, 5)
    assert joined_rows(rest) <= len(members)
    early = [(m[0], m[1], m[2], 5 + m[0], *m[4:]) if m[4] in (1, 3) else m for m in members]
    rest = ngram_join._rest(spark.createDataFrame(early, hot.schema), comps, cold, 4, 5)
    want = {(min(a, b), max(a, b)) for a in (1, 3) for b in [*range(0, 600, 2), 1, 3] if a != b}
    assert {(int(r.a), int(r.b)) for r in rest.collect()} == want


def test_jaccard_with_crowded_buckets(spark, monkeypatch):
    """Shingles of buckets with many go to several groups by class; no link is lost by that."""
    cut = ngram_join.prefixes
    monkeypatch.setattr(ngram_join, "prefixes", lambda *a: cut(*a, group_rows=40))
    pairs = near_copies(200, 2, 5) + [(300, "a b c d e f"), (301, "a b c d e f"), (302, "x y z")]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows_of(ngram_join.jaccard_components(spark, table), "doc_id", "n_shingles", "component_id") == brute_jaccard(pairs)


def test_components_of_a_long_path(spark, monkeypatch):
    import lodegraph.llm.components as c

    monkeypatch.setattr(c, "TASK_EDGES", 20)
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {250: 200, 300: 200}


def brute_windows(pairs, width):
    count = Counter()
    texts = [(i, WORD.findall(t or "")) for i, t in pairs]
    for _, w in texts:
        count.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_substring_dedup(spark, request, name):
    table = request.getfixturevalue(name)
    got = rows_of(substring_dedup.remove_repeats(spark, table), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_windows(pairs_of(table), 35)


@pytest.mark.parametrize("large", [2000, 1])
def test_substring_dedup_of_shared_passages(spark, monkeypatch, large):
    """Few different words, so that windows repeat at all places; with large = 1, through counted windows alone."""
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    rng = np.random.default_rng(3)
    shared = [f"s{k}" for k in rng.integers(0, 40, 30)]
    pairs = []
    for i in range(60):
        w = [f"a{k}" for k in rng.integers(0, 6, int(rng.integers(0, 80)))]
        pairs.append((i, " ".join(w[:20] + shared[int(rng.integers(0, 5)) :] + w[20:] + (["z"] * 25 if i % 7 == 0 else []))))
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    got = rows_of(substring_dedup.remove_repeats(spark, table, width=12, gram=4), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_windows(pairs, 12)


def test_repeated_windows_by_the_index():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 3, int(rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    weights = rng.integers(1, 3, 40)
    count = Counter()
    for s, w in zip(seqs, weights):
        for k in range(len(s) - 7):
            count[tuple(s[k : k + 8])] += int(w)
    want = [[k for k in range(len(s) - 7) if count[tuple(s[k : k + 8])] > 1] for s in seqs]
    assert [list(f) for f in repeated_windows(seqs, weights, 8)] == want
