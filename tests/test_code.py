"""Operators on files and ledgers on small cases, and the hash embedding against plain loops."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from lodegraph.functions import sketch
from lodegraph.operators import audit, graph, history, mining, resolve
from lodegraph.streaming import bus


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_paths(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/a.ts",), ("lib/c.py",)], "path string")
    asked = spark.createDataFrame([("./src/a.ts",), ("/work/lib/c.py",), ("b/a.ts",), ("a.ts",), ("none.py",), ("c.py",)], "request string")
    got = {r.request: r.path for r in resolve.match_paths(asked, files, "/work").collect()}
    # a.ts could be either of two files, so it is none.
    assert got == {"./src/a.ts": "src/a.ts", "/work/lib/c.py": "lib/c.py", "b/a.ts": "src/b/a.ts", "c.py": "lib/c.py"}
    assert one(spark, resolve.joined_path(F.col("a"), F.col("b")), a="src/m", b="../../../x/./y.ts") == "x/y.ts"


def test_imports_take_the_first_that_exists(spark):
    files = spark.createDataFrame([("a/x.tsx",), ("a/x/index.ts",), ("a/y/index.js",), ("z.py",)], "path string")
    said = spark.createDataFrame([("a/m.ts", "./x"), ("a/m.ts", "./y"), ("a/m.ts", "../z.py"), ("a/m.ts", "./w"), ("a/m.ts", "react")], "source string, spec string")
    got = {r.spec: r.found for r in resolve.resolve_imports(said, files).collect()}
    assert got == {"./x": "a/x.tsx", "./y": "a/y/index.js", "../z.py": "z.py"}


def test_symbols(spark):
    cases = {
        ("rs", "src/net/io.rs", "crate::a::b"): "a::b", ("rs", "src/net/io.rs", "self::f"): "net::io::f", ("rs", "src/net/io.rs", "super::super::f"): "f",
        ("rs", "src/net/mod.rs", "super::f"): "f", ("rs", "src/a.rs", "std::fmt"): "std::fmt",
        ("py", "pkg/sub/m.py", ".n"): "pkg.sub.n", ("py", "pkg/sub/m.py", "..n"): "pkg.n", ("py", "pkg/m.py", "os"): "os",
        ("ts", "src/app/m.ts", "../lib/x.ts"): "src/lib/x", ("tsx", "src/m.tsx", "@/y"): "root/y", ("ts", "src/m.ts", "react"): "react",
    }
    rows = spark.createDataFrame(list(cases), "language string, path string, said string")
    got = rows.select("*", resolve.canonical_symbol(F.col("language"), F.col("path"), F.col("said"), {"@/": "root/"}).alias("x")).collect()
    assert {(r.language, r.path, r.said): r.x for r in got} == cases


def test_summaries_and_shapes(spark):
    assert one(spark, resolve.doc_summary(F.col("t"), F.col("n")), t="  /// Reads. More.\nfn a()", n="n") == "Reads."
    assert one(spark, resolve.doc_summary(F.col("t"), F.col("n")), t="x\nasync fn go() {}", n="n") == "Defines async fn go."
    assert one(spark, resolve.doc_summary(F.col("t"), F.col("n")), t="", n="n") == "n"
    assert one(spark, resolve.shape(F.col("t")), t="fn go(a: u8) { if b { return c[1]; } }") == "fn ( ) { if { return [ ] ; } }"


def test_checks_fire_and_stay_quiet():
    of = {i: list(f("".join(t)))[:1] != [] for i, f, t in [
        ("deps", audit.CODE_CHECKS[0][3], "useEffect(() => { a((b)) })"), ("no deps", audit.CODE_CHECKS[0][3], "useEffect(() => { a() }, [b])"),
        ("handler", audit.CODE_CHECKS[1][3], "ipcMain.on('x', (e, d) => save(d))"), ("checked", audit.CODE_CHECKS[1][3], "ipcMain.on('x', (e, d) => s.safeParse(d))"),
        ("icon", audit.CODE_CHECKS[2][3], "<button><Icon/></button>"), ("named", audit.CODE_CHECKS[2][3], '<button aria-label="x"><Icon/></button>'), ("said", audit.CODE_CHECKS[2][3], "<button>Go</button>"),
    ]}
    assert of == {"deps": True, "no deps": False, "handler": True, "checked": False, "icon": True, "named": False, "said": False}
    hits = {i: bool(re.search(p, t)) for i, _, _, p in audit.CODE_RULES for k, t in [
        ("security.sql-concat", 'q("SELECT a FROM b WHERE c = " + d)'), ("theme.missing-dark-variant", 'class="bg-white p-2"'), ("perf.unwrap-in-async", "async fn a() { b.unwrap() }"),
        ("perf.array-from-in-loop", "for (a of b) { Array.from(a) }"), ("perf.many-state-updates", "setA(1); setB(2); setC(3)"), ("ts.untyped-param", "function f(a) {}"), ("a11y.button-focus", "<button onClick={a}>"),
    ] if k == i}
    assert len(hits) == 7 and all(hits.values())


def test_intents(spark):
    files = spark.createDataFrame([("src/a/x.rs",), ("src/b/y.ts",), ("z.md",)], "file string")
    got = {r.file: r.intent for r in mining.glob_intents(files, [("src/a/**", "frozen"), ("**/*.rs", "deferred"), ("*.md", "experimental")]).collect()}
    assert got == {"src/a/x.rs": "frozen", "z.md": "experimental"}
    docs = spark.createDataFrame([("# Plan\n- `src/a.ts`: frozen — kept\n- b.ts: deferred\nno line",)], "text string")
    assert sorted((r.file, r.intent, r.reason) for r in mining.written_intents(docs).collect()) == [("b.ts", "deferred", ""), ("src/a.ts", "frozen", "kept")]


def test_steps_and_reads(spark):
    steps = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4)], "step_id long, parent_step_id long")
    got = sorted((r.step_id, r.root, r.depth, r.path) for r in history.step_tree(steps).collect() if r.path)
    assert got == [(1, 1, 0, "1"), (2, 1, 1, "1/2"), (3, 1, 2, "1/2/3"), (4, 4, 0, "4"), (5, 4, 1, "4/5")]
    sends = spark.createDataFrame([("a", k, k != 3) for k in range(8)] + [("b", k, k % 2 == 0) for k in range(8)], "who string, at long, full boolean")
    assert [(r.who, r.evicted_at) for r in bus.evicted(sends, "who", "at", "full", 4).collect()] == [("a", 7)]


def test_communities_of_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 0.05)]
    found = {r.qualified_name: r.community_id for r in graph.communities(spark.createDataFrame(pairs, "source string, target string, weight double")).collect()}
    assert len({found[f"a{i}"] for i in range(4)}) == len({found[f"b{i}"] for i in range(4)}) == 1 and found["a1"] != found["b1"]


def test_hash_embedding_by_plain_loops():
    for text in ("", "a", "alpha beta", "Größe über é_x 12", "漢字 かな", "x y zz" * 40):
        lower, out = text.lower(), np.zeros(sketch.DIMENSIONS)
        tokens = [t.encode() for t in re.findall(r"\w+", lower) if len(t.encode()) >= 2]
        data = lower.encode()
        for part, size in [(t, 1.0) for t in tokens] + [(data[i : i + 3], 0.5) for i in range(len(data) - 2)]:
            h = sketch.fnv1a(part)
            out[h % sketch.DIMENSIONS] += size if h % 2 == 0 else -size
        out *= min(1, sketch.MAX_TOKENS / max(1, len(tokens)))
        norm = np.sqrt((out**2).sum())
        want = out / norm if norm > 1e-12 else np.eye(1, sketch.DIMENSIONS)[0]
        assert np.allclose(sketch.hash_embed(text), want)


def test_deep_chains_and_cycles_of_parents(spark):
    """Every step once: a chain of 300, a ring of 7 with tails, a step that is its own parent, repeats and unknown parents."""
    rows = [(k, k - 1 if k else None) for k in range(300)] + [(1000 + k, 1000 + (k + 1) % 7) for k in range(7)]
    rows += [(2000, 1003), (2001, 2000), (2002, 2001), (3000, 3000), (3001, 3000), (4000, 9999), (4001, 4000), (4001, 4000), (None, 1)]
    got = {r.step_id: r for r in history.step_tree(spark.createDataFrame(rows, "step_id long, parent_step_id long")).collect()}
    assert len(got) == 300 + 7 + 3 + 2 + 2
    for k in range(300):
        assert (got[k].root, got[k].depth, got[k].path, got[k].on_cycle) == (0, k, "/".join(map(str, range(k + 1))), False)
    for k in range(7):
        assert (got[1000 + k].root, got[1000 + k].depth, got[1000 + k].on_cycle) == (1000, None, True)
    assert [(got[k].root, got[k].path, got[k].on_cycle) for k in (2000, 2001, 2002)] == [(1000, None, False)] * 3
    assert (got[3000].root, got[3000].on_cycle, got[3001].root, got[3001].on_cycle) == (3000, True, 3000, False)
    assert (got[4000].path, got[4001].path) == ("4000", "4000/4001")
    assert history.step_tree(spark.createDataFrame([], "step_id long, parent_step_id long")).collect() == []


def test_paths_are_not_moved_whole_round_by_round(spark, monkeypatch):
    """Chains of 200 and a comb: what is saved on the way holds far fewer characters than the paths do."""
    rows = [(1000 * c + k, 1000 * c + k - 1 if k else None) for c in range(5) for k in range(200)]
    rows += [(100_000 + k, k - 1) for k in range(1, 100)]
    held, saved = [], history.saved

    def watched(df):
        out = saved(df)
        held.extend(out.agg(F.coalesce(F.sum(F.length(c)), F.lit(0))).first()[0] for c in out.columns if c in ("path", "tail", "part"))
        return out

    monkeypatch.setattr(history, "saved", watched)
    got = {r.step_id: r for r in history.step_tree(spark.createDataFrame(rows, "step_id long, parent_step_id long")).collect()}
    for c in range(5):
        assert all(got[1000 * c + k].path == "/".join(str(1000 * c + i) for i in range(k + 1)) for k in range(200))
    assert all(got[100_000 + k].path == got[k - 1].path + f"/{100_000 + k}" and got[100_000 + k].depth == k for k in range(1, 100))
    assert sum(held) < sum(len(r.path) for r in got.values())


def test_calls_and_paths_meet_few_rows(spark):
    from lodegraph.operators import relational, resolve

    index = spark.createDataFrame([("f", f"q{i}", f"file{i % 50}", i) for i in range(2000)], "name string, qualified_name string, file_path string, ord long")
    calls = spark.createDataFrame([(i, f"file{i}", "m::x.f") for i in range(60)] + [(99, None, "f"), (100, "file1", "g")], "id long, file_path string, callee string")
    got = {r.id: r.target for r in relational.resolve_calls(calls, index).collect()}
    assert got == {**{i: f"q{i}" if i < 50 else "q0" for i in range(60)}, 99: "q0"}
    files = spark.createDataFrame([("src/a/index.ts",), ("src/b/index.ts",), ("lib/c/x.ts",), ("/abs/y.ts",)], "path string")
    asked = spark.createDataFrame([("index.ts",), ("a/index.ts",), ("x.ts",), ("src/b/index.ts",), ("abs/y.ts",)], "request string")
    assert {r.request: r.path for r in resolve.match_paths(asked, files).collect()} == {
        "a/index.ts": "src/a/index.ts", "x.ts": "lib/c/x.ts", "src/b/index.ts": "src/b/index.ts", "abs/y.ts": "/abs/y.ts"
    }


def plain_channels(docs, declared):
    """File by file, with the patterns' places in the text."""
    out = []
    for key, extension, text in docs:
        if extension.lower() not in audit.SCRIPTS or not declared or not text:
            continue
        keys = set(re.findall(audit.BRIDGE_KEY, text)) if re.search(audit.BRIDGE, text) else set()
        for pattern, rule in ((audit.CALL, "ipc.unknown-channel"), (audit.HANDLER, "ipc.handler-not-in-types")):
            for m in re.finditer(pattern, text):
                if m[1] not in declared and not (rule == "ipc.unknown-channel" and m[1] in keys):
                    out.append((key, rule, m[1], text.count("\n", 0, m.start()) + 1))
    return sorted(out)


def test_channels_against_their_types(spark):
    docs = [
        ("a", "ts", "x\nipcRenderer.invoke('load')\n\nipcRenderer.send(\n\n  \"gone\"); ipcRenderer.on('gone', f)\nipcMain.on('late', f)"),
        ("b", "TSX", "contextBridge.exposeInMainWorld('api', {\n  open: () => ipcRenderer.invoke('open'),\n  other: () => ipcRenderer.invoke('shut')\n})"),
        ("c", "js", "ipcRenderer.invoke('open')\nipcMain.handle('load', f)\nipcMain.handle('Open', f)"),
        ("d", "py", "ipcRenderer.invoke('nowhere')"), ("e", "ts", None), ("f", "ts", ""), ("c", "js", "ipcRenderer.invoke('open')"),
    ]
    rows = spark.createDataFrame(docs, "doc_key string, extension string, text string").withColumn("line", F.lit("clash")).withColumn("keys", F.lit(1))
    types = spark.createDataFrame([("type A = 'load' | \"Open\" | 'a b'",), (None,), ("'load' 'x:y/z'",)], "text string")
    declared = audit.declared_channels(types)
    assert sorted(r.channel for r in declared.collect()) == ["load", "x:y/z"]
    for known in (declared, declared.limit(0)):
        got = sorted((r.doc_key, r.rule_id, r.channel, r.line) for r in audit.channel_findings(rows, known).collect())
        assert got == plain_channels(docs, {r.channel for r in known.collect()})
    assert audit.channel_findings(rows.limit(0), declared).count() == 0
