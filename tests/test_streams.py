from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import ledger
from lodegraph.sources import files as S
from lodegraph.streaming import bus


@pytest.mark.parametrize("pattern,topic,hit", [
    ("project.*.file_changed", "project.abc.file_changed", True), ("project.*.file_changed", "project.abc.def.file_changed", False),
    ("project.abc.#", "project.abc.x", True), ("project.abc.#", "project.abc.x.y", True), ("project.abc.#", "project.abc", False), ("#", "any.thing", True),
])
def test_topics(spark, pattern, topic, hit):
    e = spark.createDataFrame([(topic,)], "topic string")
    assert bool(bus.subscribed(e, pattern).count()) is hit


def test_valid_topics(spark):
    got = spark.createDataFrame([(t,) for t in ("a.b", "a..b", "", "a b", ".a")], "t string").select(bus.valid_topic(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


BURSTS = [("p", 0, "upsert"), ("p", 100, "delete"), ("p", 200, "upsert"), ("p", 600, "upsert")]


def test_debounce(spark):
    e = spark.createDataFrame(BURSTS, "path string, ms long, kind string").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted((r.n, r.kind) for r in bus.debounce(e, "path", "ts", "kind").collect())
    assert got == [(1, "upsert"), (3, "delete")]


def test_debounce_and_rates_on_a_stream(spark, tmp_path):
    rows = [*BURSTS, ("q", 9_000_000, "upsert")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, ms long, kind string").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ms long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bus.debounce_stream(stream, "path", "ts", "kind").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.kind) for r in spark.sql("SELECT * FROM bursts WHERE path = 'p'").collect()) == [(1, "upsert"), (3, "delete")]
    q = bus.rates(stream, "ts", "1 second", 1.0, late="1 second").writeStream.format("memory").queryName("rates").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.per_second) for r in spark.sql("SELECT * FROM rates").collect()] == [(4, 4.0)]


def test_versions_by_batch(spark, tmp_path):
    for v in (1, 2):
        spark.createDataFrame([("k", v)], "path string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bus.upsert_each(stream, str(tmp_path / "out"), "path", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert bus.latest_version(spark.read.parquet(str(tmp_path / "out")), "path").count() == 1


def test_tail_and_changes(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)], "k string, i int")
    assert sorted(r.i for r in bus.tail(rows, "k", "i", 2).collect()) == [3, 4]
    now, old = (spark.createDataFrame(x, "path string, digest string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3")]))
    assert [r.path for r in bus.changed_only(now, old).collect()] == ["b"]


def test_source_tree_and_syntax(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "m/a.py").write_text("import os\n\nclass A(B):\n    @d\n    def f(self):\n        return g(1)\n")
    (tmp_path / "m/b.bin").write_bytes(b"a\x00b")
    (tmp_path / "node_modules/c.py").write_text("x = 1")
    tree = S.source_tree(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.language) for r in tree.collect()] == [("a.py", "python")]
    got = S.syntax_graph(tree).collect()
    assert sorted((r.kind, r.name) for r in got if r.record == "node") == [("class", "A"), ("file", "a.py"), ("function", "f")]
    assert {(r.kind, r.target) for r in got if r.kind in ("imports", "inherits", "calls", "decoratedby")} == {("imports", "os"), ("inherits", "B"), ("calls", "g"), ("decoratedby", "d")}


def test_manifests(spark):
    rows = [
        ("x/package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("requirements.txt", "numpy>=2.0\n# note\npandas\n"),
        ("Cargo.toml", '[package]\nname = "p"\n[dependencies]\nserde = "1.0"\n[dev-dependencies]\nrand = { version = "0.8" }\n'),
    ]
    got = S.manifest_dependencies(spark.createDataFrame(rows, "path string, text string"))
    assert sorted((r.package, r.version, r.is_dev) for r in got.collect()) == [("a", "^1", False), ("b", "2", True), ("numpy", "2.0", False), ("pandas", "", False), ("rand", "0.8", True), ("serde", "1.0", False)]


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\nmore\n#### deep\n```py\nx = 1\n```\n[l](t.md)")], "id int, text string")
    assert [(r.level, r.title) for r in S.sections(docs, "id").orderBy("pos").collect()] == [(1, "One"), (2, "Two")]
    got = S.markdown_parts(docs, "id").first()
    assert [(x.label, x.target) for x in got.links] == [("l", "t.md")] and [x.strip() for x in got.code_blocks] == ["x = 1"]


def test_log_and_sinks(spark, tmp_path):
    log = spark.createDataFrame([("abc|me|2024-01-02T03:04:05Z|fix | pipe",), ("junk",)], "value string")
    assert [(r.sha, r.message) for r in S.commits(log).collect()] == [("abc", "fix | pipe")]
    stat = spark.createDataFrame([("abc", "3\t-\ta.py"), ("abc", "x")], "sha string, value string")
    assert [(r.path, r.additions, r.deletions) for r in S.commit_files(stat).collect()] == [("a.py", 3, 0)]
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    out = str(tmp_path / "t")
    assert [S.append_once(rows, out, "k", str(tmp_path / "audit")), S.append_once(rows, out, "k")] == [2, 0]
    S.snapshot({"t": rows}, str(tmp_path / "snap"), "v1")
    assert S.restore(spark, str(tmp_path / "snap"), "v1", "t").count() == 2


def test_exports_and_gate(spark):
    n = spark.createDataFrame([("a<", "f", "fn")], "qualified_name string, kind string, name string")
    e = spark.createDataFrame([("a<", "b'", "calls")], "source string, target string, kind string")
    assert S.graphml_rows(n, e).first().value == '<node id="a&lt;"><data key="kind">f</data></node>'
    assert S.cypher_rows(n, e).collect()[1].value == "MATCH (a {id: 'a<'}), (b {id: 'b\\''}) CREATE (a)-[:CALLS]->(b);"
    assert S.jsonld_rows(n, e).count() == 2
    assert S.allowed_sql("SELECT ';' AS a;") and not S.allowed_sql("SELECT 1; DROP TABLE x") and not S.allowed_sql("SELECT 1 -- x") and S.allowed_sql("insert into t values (1)", True)


def test_semantic_recall(spark):
    rows = [(i, i % 50, None if i % 7 == 0 else [9.0 if i < 3 else float(i % 5), 1.0], "deep" if i < 3 else "new") for i in range(100)]
    entries = spark.createDataFrame(rows, "id int, at int, vec array<float>, text string")
    hits = entries.filter("text = 'deep'")
    got = [r.id for r in ledger.semantic_recall(entries, "id", "at", "vec", [1.0, 0.0], hits, 6).collect()]
    newest = lambda found: sorted(found, key=lambda r: (-r[1], r[0]))[:24]
    pool = {r[0]: r for r in newest(rows) + newest([r for r in rows if r[3] == "deep"])}
    cos = lambda v: 0.0 if v is None else v[0] / (v[0] ** 2 + 1) ** 0.5
    assert got == [r[0] for r in sorted(pool.values(), key=lambda r: (-round(cos(r[2]), 9), -r[1], r[0]))[:6]]
    assert got[:2] == [2, 1]  # old, and found by the search alone
    every = ledger.semantic_recall(entries, "id", "at", "vec", [1.0, 0.0], None, 100)
    assert every.count() == 100 and every.filter("vec IS NULL AND score <> 0").count() == 0
    assert ledger.semantic_recall(entries.limit(0), "id", "at", "vec", [1.0]).count() == 0
