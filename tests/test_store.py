"""The keyed store against a plain dictionary, its versions and its repeated batches; scan_text through SQL."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import audit
from lodegraph.sources.store import KeyedStore

SCHEMA = "key string, at long, tags map<string,int>"


def rows(df):
    return sorted(((r.key, r.at, r.tags) for r in df.collect()), key=repr)


def test_upserts_and_deletes_like_a_dictionary(spark, tmp_path):
    rng, held, want, states = random.Random(5), KeyedStore(spark, f"file://{tmp_path}/s", "key", 4), {}, []
    for at in range(4):
        batch = [(rng.choice([None, *"abcdefgh"]), 10 * at + rng.randrange(9), {"n": at}) for _ in range(6)]
        newest = {}
        for r in batch:
            newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[1])
        for k, r in newest.items():
            want.pop(k, None)
            if r[1] % 3:
                want[k] = r
        assert held.upsert(spark.createDataFrame(batch, SCHEMA), "at", F.col("at") % 3 == 0) == at + 1
        states.append(sorted(want.values(), key=repr))
        assert rows(held.read()) == states[-1]
    assert [rows(held.read(v + 1)) for v in range(4)] == states
    assert [(r.version, r.n_rows) for r in held.versions().collect()] == [(v + 1, len(s)) for v, s in enumerate(states)]
    assert KeyedStore(spark, f"file://{tmp_path}/s", "key", 99).buckets == 4
    assert held.expire(2) == [1, 2] and [rows(held.read(v)) for v in (3, 4)] == states[2:]
    with pytest.raises(ValueError):
        held.read(1)


def test_replace_puts_all_rows_of_a_key_and_empty_batches_change_nothing(spark, tmp_path):
    held = KeyedStore(spark, f"file://{tmp_path}/s", "key", 3)
    empty = spark.createDataFrame([], SCHEMA)
    assert held.upsert(empty, "at") == 1 and rows(held.read()) == []
    held.replace(spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, None)], SCHEMA))
    held.replace(spark.createDataFrame([("a", 3, None)], SCHEMA))
    assert rows(held.read()) == [("a", 3, None), ("b", 2, None)]
    assert held.upsert(empty, "at") == 4 and rows(held.read()) == [("a", 3, None), ("b", 2, None)]
    held.replace(empty, spark.createDataFrame([("b",)], "key string"))
    assert rows(held.read()) == [("a", 3, None)]


def test_repeated_batches_count_once_and_old_folders_go(spark, tmp_path):
    held = KeyedStore(spark, f"file://{tmp_path}/s", "key", 2)
    one, two = (spark.createDataFrame([("a", n, None)], SCHEMA) for n in (1, 2))
    assert [held.upsert(one, "at", batch=0), held.upsert(two, "at", batch=1), held.upsert(one, "at", batch=0)] == [1, 2, 2]
    assert rows(held.read()) == [("a", 2, None)]
    held.expire()
    assert len([p for p in (tmp_path / "s/data").iterdir()]) == 1 and not list((tmp_path / "s/changes").iterdir())


def test_scan_text_in_sql_equals_scan(spark):
    docs = [("a", "eval(x)\nconst v: any = 1", "ts"), ("b", None, "ts"), ("c", "eval(x) mail a@b.org", None), ("d", "", "py")]
    made = spark.createDataFrame(docs, "doc_key string, text string, extension string")
    audit.register(spark)
    for name, rules in (("code", audit.CODE_RULES + audit.CODE_CHECKS), ("security, privacy", [r for r in audit.CODE_RULES + audit.CODE_CHECKS + audit.PROSE_RULES if r[0].split(".")[0] in ("security", "privacy")])):
        sql = f"SELECT d.doc_key, s.* FROM {{docs}} d, LATERAL scan_text(d.text, d.extension, '{name}') s"
        assert sorted(spark.sql(sql, docs=made).collect()) == sorted(audit.scan(made, rules, extension="extension").collect())
    with pytest.raises(Exception, match="no rules are named zzz"):
        spark.sql("SELECT * FROM scan_text('x', 'ts', 'zzz')").collect()


def test_stream_percentiles_keep_the_last_samples_over_batches(spark, tmp_path):
    from lodegraph.streaming.state import STATE_STORE, last_percentiles

    rng, schema = random.Random(3), "kind string, at timestamp, id long, value double"
    events = [(rng.choice(["a", "b", None]), 1_700_000_000 + i // 3, i, rng.choice([None, *range(9)])) for i in range(60)]
    for part in (events[20:40], events[:20], events[40:]):  # late rows come first
        made = spark.createDataFrame([(k, t, i, None if v is None else float(v)) for k, t, i, v in part], "kind string, t long, id long, value double")
        made.selectExpr("kind", "timestamp_seconds(t) AS at", "id", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    held = KeyedStore(spark, f"file://{tmp_path}/out", "key", 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held.upsert_stream(last_percentiles(stream, "kind", "at", "id", "value", 5), "n", f"{tmp_path}/checkpoint").awaitTermination()
    spark.conf.set(STATE_STORE[0], before)
    want = {}
    for kind in ("a", "b", None):
        last = sorted(v for k, _, _, v in [e for e in events if e[0] == kind and e[3] is not None][-5:])
        want[kind] = (len(last), *[float(last[min(int(q * len(last)), len(last) - 1)]) for q in (0.5, 0.95, 0.99)])
    assert {r.key: (r.n, r.p50, r.p95, r.p99) for r in held.read().collect()} == want
