"""The two classifiers: held-out accuracy, defined cases, and the fits on small examples."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import quality, toxicity
from lodegraph.llm.hashed import Rows

MIDDLE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def middle(spark):
    read = lambda t: spark.read.parquet(f"{MIDDLE}/{t}.parquet")
    return read("documents"), read("labels")


def test_quality_agrees_with_labels_it_never_saw(spark, middle):
    docs, labels = middle
    got = {r.doc_id: r.keep for r in quality.classify(spark, docs).select("doc_id", "keep").collect()}
    told = [(got[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None]
    good = [keep for keep, q in told if q == 1]
    bad = [not keep for keep, q in told if q == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.9


@pytest.mark.parametrize("name", ["edge", "none"])
def test_quality_of_odd_tables(spark, request, name):
    table = request.getfixturevalue(name)
    rows = quality.classify(spark, table).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in table.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.keep == (r.score >= 0.5) for r in rows)
    kept = quality.good_only(spark, table)
    assert kept.columns == table.columns
    assert sorted(repr(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(repr(r.doc_id) for r in rows if r.keep)


def test_posteriors_are_those_of_counted_votes(spark, docs):
    texts = [r.text for r in docs.select("text").collect()]
    patterns = dict(Counter(quality.votes(t) for t in texts))
    assert quality.vote_patterns(docs) == patterns
    posterior = quality.fit_labellers(patterns)[0]
    got = {r.votes: r.posterior for r in quality.classify(spark, docs).select("votes", "posterior").collect()}
    for v, p in got.items():
        if v.strip(quality.SILENT):
            assert p == pytest.approx(posterior[v])


def test_labellers_with_known_accuracy():
    """Votes drawn from labellers of known accuracy: the estimates come near it and posteriors find the classes."""
    rng, n = np.random.default_rng(0), 20_000
    truth = rng.random(n) < 0.7
    accuracy = np.linspace(0.7, 0.95, len(quality.LABELLERS))
    said = np.where(rng.random((n, len(accuracy))) < accuracy, truth[:, None], ~truth[:, None])
    said = np.where(rng.random(said.shape) < 0.3, quality.SILENT, np.where(said, quality.GOOD, quality.BAD))
    keys = ["".join(v) for v in said]
    posterior, right, prior = quality.fit_labellers(dict(Counter(keys)))
    assert np.mean((np.array([posterior[k] for k in keys]) > 0.5) == truth) > 0.97
    assert np.allclose([g for g, _ in right], accuracy, atol=0.05)
    assert abs(prior - 0.7) < 0.05


def test_every_word_of_a_text_counts():
    clean = "The quiet river runs past the old mill and the town. " * 400
    noise = "@@@ ### $$$ %%% " * 4000
    assert quality.votes(clean) != quality.votes(clean + noise)
    assert quality.variety("", clean.split()) == quality.variety("", (clean + clean).split())


def test_toxicity_on_held_out_labels(spark, middle):
    docs, labels = middle
    scored = {r.doc_id: r for r in toxicity.score(spark, docs, labels).collect()}
    for r in scored.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    told = [(scored[r.doc_id].score, r.toxic) for r in labels.collect() if scored[r.doc_id].held_out and r.toxic is not None]
    hit = sum(s >= 0.5 and t == 1 for s, t in told)
    assert hit / max(1, sum(t == 1 for _, t in told)) >= 0.85
    assert hit / max(1, sum(s >= 0.5 for s, _ in told)) >= 0.85


def test_toxicity_never_reads_held_out_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    score = lambda t: {r.doc_id: r.score for r in toxicity.score(spark, docs, t).collect()}
    assert score(labels) == score(flipped)


@pytest.mark.parametrize("name", ["edge", "none"])
def test_toxicity_of_odd_tables(spark, request, name):
    table = request.getfixturevalue(name)
    labels = spark.createDataFrame([(6, 1, 1), (6, 1, 0), (1, 1, 0), (99, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for told in (labels, labels.limit(0)):
        rows = toxicity.score(spark, table, told).collect()
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in table.select("doc_id").collect())
        assert all(0 <= r.score <= 1 for r in rows)


def test_risk_separates_positives_from_unlabelled():
    rng = np.random.default_rng(1)
    toxic = lambda: np.append(rng.choice(50, 5, replace=False), 90)
    clean = lambda: rng.choice(50, 6, replace=False)
    positive = Rows.of([toxic() for _ in range(200)])
    unlabelled = Rows.of([toxic() if i % 10 == 0 else clean() for i in range(2000)])
    w, bias = toxicity.fit(positive, unlabelled, 0.1, 100, steps=1000)  # to convergence: a few sharp features need more steps than text
    assert np.mean([w[toxic()].sum() + bias > 0 for _ in range(200)]) > 0.95
    assert np.mean([w[clean()].sum() + bias < 0 for _ in range(200)]) > 0.95


def test_quality_scores_by_plain_loops(spark, docs):
    """Expectation-maximisation over single documents, and gradient steps over a full matrix."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    said = {i: quality.votes(t) for i, t in texts.items()}
    post = {i: 0.1 if "0" in v else 0.9 for i, v in said.items()}
    for _ in range(200):
        prior = (sum(post.values()) + 1) / (len(post) + 2)
        good, bad = [], []
        for k in range(len(quality.LABELLERS)):
            of = lambda votes, p: sum(p(i) for i, v in said.items() if v[k] in votes)  # noqa: B023, E731
            good.append(min(0.9995, max(0.5, (of("1", post.get) + 9) / (of("01", post.get) + 10))))
            bad.append(min(0.9995, max(0.05, (of("0", lambda i: 1 - post[i]) + 8) / (of("01", lambda i: 1 - post[i]) + 10))))
        for i, v in said.items():
            yes, no = prior, 1 - prior
            for k, c in enumerate(v):
                yes *= good[k] if c == "1" else 1 - good[k] if c == "0" else 1
                no *= 1 - bad[k] if c == "1" else bad[k] if c == "0" else 1
            post[i] = yes / (yes + no)
    shapes, ids = quality.Shapes(), sorted(texts)
    x = np.zeros((len(ids), 1 << quality.SHAPE_BITS))
    for r, i in enumerate(ids):
        cols, vals = quality.features(texts[i], shapes)
        np.add.at(x[r], cols, vals)
    used = np.flatnonzero(x.any(0))
    x, y = np.c_[x[:, used], np.ones(len(ids))], np.array([post[i] for i in ids])
    w = m = v = np.zeros(x.shape[1])
    for t in range(1, 301):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(ids) + 1e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    want = dict(zip(ids, 1 / (1 + np.exp(-x @ w))))
    got = {r.doc_id: r for r in quality.classify(spark, docs).collect()}
    assert all(got[i].posterior == pytest.approx(post[i], abs=1e-6) and got[i].score == pytest.approx(want[i], abs=2e-3) for i in ids)
    assert {i for i in ids if got[i].keep} == {r.doc_id for r in quality.good_only(spark, docs).collect()}


def test_toxicity_scores_by_plain_loops(spark):
    """The corrected risk with a full matrix, all rows and the same draws of batches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    open_ = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    told = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and open_(r.doc_id)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = lambda t: set(toxicity.WORD.findall((t or "").lower()))
    of = {i: {f for w in words(t) for f in toxicity.word_features(w)} for i, t in texts.items()}
    sure = [i for i in sorted(texts) if told.get(i) == 1]
    free = [i for i in sorted(texts) if open_(i)]
    seen = Counter(f for i in sure for f in of[i])
    kept = sorted(f for f, n in seen.items() if n >= max(3, len(sure) // 400))
    at = {f: k for k, f in enumerate(kept)}
    def matrix(ids):
        x = np.zeros((len(ids), len(kept)))
        for r, i in enumerate(ids):
            x[r, [at[f] for f in of[i] if f in at]] = 1
        return x
    xp, xu, prior = matrix(sure), matrix(free), sum(told.values()) / len(told)
    rng, w, b = np.random.default_rng(7), np.zeros(len(kept)), np.log(prior / (1 - prior))
    m = v = np.zeros(len(kept) + 1)
    for t in range(1, 301):
        p, u = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        pp, pu = (rng.random(len(p)) < 0.5) / (0.5 * len(p)), (rng.random(len(u)) < 0.5) / (0.5 * len(u))
        rest = -(pu @ np.log1p(-np.minimum(u, 1 - 1e-12))) + prior * (pp @ np.log1p(-np.minimum(p, 1 - 1e-12)))
        gp, gu = (prior * pp * (p - 1) - prior * pp * p, pu * u) if rest >= 0 else (prior * pp * p, -pu * u)
        g = np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * (1 - (t - 1) / 300)
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * 0.1)
    want = dict(zip(texts, 1 / (1 + np.exp(-(matrix(list(texts)) @ w + b)))))
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, labels).collect()}
    assert max(abs(got[i] - want[i]) for i in texts) < 2e-3


def test_samples_are_bounded_whatever_repeats(spark):
    from lodegraph.llm.common import lowest, mark

    of_row = mark("id", F.lit(0), 3)
    for df, n in ((spark.range(200_000), 200_000), (spark.range(200_000).select((F.col("id") % 3).alias("id")), 3), (spark.range(0), 0)):
        for most in (1, 2_000, 10**9):
            assert df.filter(lowest(df, of_row, most)).distinct().count() == min(most, n)


@pytest.mark.parametrize("ids", ["0", "1", "2", "5", "cast(null as long)", "id"])
def test_repeated_ids_and_rows(spark, ids):
    """20000 rows of one id, alike or not: the fits read no more than they may, and all rows are scored."""
    words = "concat('good words about the river ', id, ' and the town. ', repeat('more of it ', 20))"
    for text in (words, "'the same text. '"):
        docs = spark.range(20_000).selectExpr(f"{ids} AS doc_id", f"{text} AS text")
        seen = quality.looked_at(docs)
        chosen = seen.filter(quality.lowest(seen, F.col("mark"), 500)).dropDuplicates(["mark"])
        assert 1 <= chosen.count() <= 500
        assert quality.classify(spark, docs, 500).count() == 20_000
        labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
        rows = toxicity.score(spark, docs, labels, most_positive=300, most_unlabelled=300)
        assert rows.agg(F.count("score"), F.min("score") >= 0, F.max("score") <= 1).first() == (20_000, True, True)


def test_toxicity_without_a_readable_example(spark):
    """All rows held out, or without ids: the prior's score for all."""
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 0)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 180)], "doc_id long, quality int, toxic int")
    open_ = [i % 4 == 0 for i in range(100, 180) if zlib.crc32(str(i).encode()) % 5]
    for rows in ([(held, "some text")], [(None, "a"), (None, None)]):
        got = toxicity.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
        assert len(got) == len(rows) and all(r.score == pytest.approx(sum(open_) / len(open_)) for r in got)


def test_one_very_long_text_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100)
    docs = spark.createDataFrame([(1, "long words " * 500)], "doc_id long, text string")
    assert quality.classify(spark, docs).count() == 1


def test_larger_samples_score_alike(spark, middle):
    docs, labels = middle
    told = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    for most in (1_000, 100_000):
        rows = [(r.predicted, told[r.doc_id]) for r in toxicity.score(spark, docs, labels, most_positive=most, most_unlabelled=most).collect() if r.held_out and r.doc_id in told]
        hit = sum(p and t for p, t in rows)
        print(most, "caught", hit / max(1, sum(t for _, t in rows)), "right", hit / max(1, sum(p for p, _ in rows)))
        assert hit / max(1, sum(t for _, t in rows)) >= 0.8
