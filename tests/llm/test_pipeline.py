"""The pipeline against a brute-force version, stage by stage, and the entry points."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_duplicates import brute_jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from lodegraph.llm import quality
from lodegraph.llm.common import written

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    found = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, at, SMALL), "test-stage")
        found.append((name, at, after))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        at = after
    assert [n for n, _, _ in found] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    kept = {r.doc_id for r in quality.classify(spark, docs).collect() if r.keep}
    assert set(rows(found[0][2])) == kept

    texts = defaultdict(list)
    for r in rows(found[1][1]).values():
        texts[r.text or ""].append(r.doc_id)
    assert set(rows(found[1][2])) == {max(ids) for ids in texts.values()}

    comps = brute_jaccard([(r.doc_id, r.text) for r in rows(found[2][1]).values()])
    assert set(rows(found[2][2])) == {i for i, _, c in comps if i == c}
    assert rows(found[3][2]) == rows(found[3][1])

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows(found[4][1]).values():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = found[4][2].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in got)


def test_stages_on_odd_tables(spark, edge, none):
    for table in (edge, none):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, SMALL), "test-odd")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert at.columns == table.columns
                assert at.filter("comp = 'clash' AND `map` = 'clash' AND piece = 'clash'").count() == at.count()
        assert at.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_entry_has_them_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_sources_mix_over_the_sequences(spark):
    from collections import Counter

    rows = [(i, "web" if i % 51 else "books", " ".join(f"w{(i * 7 + k) % 90}" for k in range((20, 31, 44, 600)[0 if i % 40 else 3] if i % 3 else (31, 44)[i % 2]))) for i in range(20_400)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    source = {i: s for i, s, _ in rows}
    placed = corpus_pipeline.packed(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in placed) == list(range(20_400))
    last = max(r.sequence_id for r in placed)
    assert {r.sequence_id for r in placed} == set(range(last + 1))
    # Books have weight 32 of 256: their 400 documents, 13 blocks, last for 104 of 638 slots at that share, and none is left for the others.
    share, run_out = 32 / 256, 104 / 638
    shares = []
    for a, b in ((0, run_out / 2), (run_out / 2, run_out - 0.03), (run_out + 0.05, 1.01)):
        n = Counter(source[r.doc_id] for r in placed if a * last <= r.sequence_id < b * last)
        shares.append(n["books"] / (n["books"] + n["web"]))
    assert abs(shares[0] - share) < 0.27 * share and abs(shares[1] - share) < 0.27 * share and shares[2] < 0.003, shares


def test_repeated_rows_stay_once(spark, edge, docs):
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, edge, SMALL).collect()), key=repr)
    texts = defaultdict(list)
    for r in edge.collect():
        texts[r.text or ""].append((r.doc_id is not None, r.doc_id or 0, r.text))
    want = [(max(rows)[1], t) for t, rows in texts.items() if t]
    assert sorted((x for x in kept if x[1]), key=repr) == sorted(want, key=repr)
    assert [i for i, t in kept if not t] == [4] and (8, "short text") in kept and len(kept) == len(texts)

    twice = corpus_pipeline.drop_copies(spark, docs.union(docs), SMALL).collect()
    once = corpus_pipeline.drop_copies(spark, docs, SMALL).collect()
    assert sorted(map(repr, twice)) == sorted(map(repr, once))

    shared = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, "b")], "doc_id long, text string")
    assert sorted((tuple(r) for r in corpus_pipeline.drop_copies(spark, shared, SMALL).collect()), key=repr) == [(1, "b"), (2, "a"), (None, "c")]


def test_stages_judge_rows(spark):
    """Rows that repeat, or share an id but not a text, after every stage."""
    prose = "The committee met on Tuesday. It decided to build a new school near the old bridge by the river. Many people came to the meeting. "
    a, b = prose + " ".join(f"word{k}" for k in range(60)) + ".", prose + " ".join(f"other{k}" for k in range(60)) + "."
    near = a.replace("word59", "changed")
    rows = [(2, a), (2, a), (2, b), (3, a), (4, near), (4, b + " And one more."), (5, near), (None, a), (6, None), (6, None)]
    table = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    table = table.withColumns({c: F.lit(c) for c in ("map", "piece", "mix_id", "mix_at", "row", "id", "sha", "stays", "maybe", "__piece")})
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    once = corpus_pipeline.drop_copies(spark, table, SMALL)
    assert once.columns == table.columns
    assert of(once) == sorted([(3, a), (2, b), (5, near), (4, b + " And one more."), (6, None)], key=repr)
    apart = corpus_pipeline.drop_near_copies(spark, table, SMALL)
    assert apart.columns == table.columns
    # One of the first group and one of the second stay; without id or words, rows pass.
    kept = of(apart)
    assert len([x for x in kept if x[0] is not None and x[1]]) == 2 and all(i == 2 for i, t in kept if i is not None and t)
    assert kept.count((None, a)) == 1 and kept.count((6, None)) == 2
    both = corpus_pipeline.drop_near_copies(spark, written(once, "test-once"), SMALL)
    assert of(both) == sorted([(3, a), (2, b), (6, None)], key=repr)
    mixed = corpus_pipeline.mixed(spark, written(both, "test-both"), SMALL)
    assert mixed.columns == table.columns and of(mixed) == of(both)
    assert mixed.filter("`map` = 'map' AND maybe = 'maybe' AND __piece = '__piece'").count() == 3


def test_columns_of_any_type(spark):
    rows = [(i, "The same words in a row, said again and again by the people of the town. " * 4) for i in (1, 1, 2, 3)] + [(4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'web' AS source", "map('k', doc_id) AS m", "array(map(doc_id, struct(doc_id AS x, map('a', 1) AS y))) AS nested", "parse_json('{\"a\": [1]}') AS v", "cast(text AS binary) AS raw"
    )
    at = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        at = written(stage(spark, at, SMALL), "test-types")
        assert at.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r.doc_id, r.m) for r in at.collect()) == [(3, {"k": 3}), (4, {"k": 4})]
    quality.good_only(spark, docs).count()
