"""Queries of the operators on files, over the made source tree of lodegraph.sources.code."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import audit, mining, resolve
from lodegraph.operators.relational import orphans, resolve_calls
from lodegraph.plans.registry import CONTAINMENT, NODES, Registry
from lodegraph.sources import files as S
from lodegraph.sources.code import CHANNEL_SCRIPTS, CHANNEL_TYPES, FILES, MANIFESTS, TESTS, for_sql, made
from lodegraph.sources.tables import table

Q = Registry()
WITH_FILES = f"WITH files AS ({for_sql(FILES)})"
SCRIPT = "extension IN ('ts', 'tsx')"


def _files(spark, d):
    return made(spark, d, FILES)


def _docs(spark, d):
    return _files(spark, d).withColumn("doc_key", F.col("path"))


REQUESTS = """
SELECT CASE id % 3 WHEN 0 THEN concat('./', path) WHEN 1 THEN concat('/work/', replace(path, '/', chr(92))) ELSE concat('f', id, '.', extension) END AS request, path
FROM files WHERE id % 9 < 3
"""


@Q.add("P10_path_candidates", f"{WITH_FILES} {REQUESTS}")
def path_candidates(spark, d):
    files = _files(spark, d)
    request = F.expr("CASE id % 3 WHEN 0 THEN concat('./', path) WHEN 1 THEN concat('/work/', translate(path, '/', chr(92))) ELSE concat('f', id, '.', extension) END")
    asked = files.filter("id % 9 < 3").select(request.alias("request"))
    plain = asked.select(F.translate("request", "\\", "/").alias("plain"), "request")
    met = resolve.match_paths(plain.select(F.col("plain").alias("request")), files, "/work")
    return plain.join(met.withColumnRenamed("request", "plain"), "plain").select("request", "path")


@Q.add(
    "J13_G17_imports",
    f"""{WITH_FILES}, said AS (
      SELECT id, path, './f' || (id + 20) AS spec, folder || '/f' || (id + 20) || '.' || extension AS target FROM files WHERE {SCRIPT}
      UNION ALL SELECT id, path, '../m' || ((id + 1) % 4) || '/f' || (id + 5), 'src/m' || ((id + 5) % 4) || '/f' || (id + 5) || '.' || extension FROM files WHERE {SCRIPT})
    SELECT path AS source, spec, target AS found FROM said WHERE target IN (SELECT path FROM files)""",
)
def imports(spark, d):
    files = _files(spark, d)
    two = F.explode(F.array(F.expr("concat('./f', id + 20)"), F.expr("concat('../m', (id + 1) % 4, '/f', id + 5)"), F.lit("react")))
    return resolve.resolve_imports(files.filter(SCRIPT).select(F.col("path").alias("source"), two.alias("spec")), files)


@Q.add(
    "J14_A12_M10_test_coverage",
    f"""{WITH_FILES}, tests AS ({for_sql(TESTS)}), paired AS (
      SELECT f.path, f.id, t.path AS test_path, t.n FROM files f LEFT JOIN tests t ON t.path IN (
        f.folder || '/f' || f.id || '.test.' || f.extension, f.folder || '/__tests__/f' || f.id || '.test.' || f.extension,
        'tests/test_f' || f.id || '.' || f.extension, 'tests/f' || f.id || '_test.' || f.extension))
    SELECT path, test_path, (CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END + coalesce(n, 0))::BIGINT AS n_tests,
      CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END + coalesce(n, 0) > 0 AS covered,
      CASE WHEN test_path LIKE '%.test.%' THEN 'jest' WHEN test_path LIKE '%.py' THEN 'pytest' WHEN test_path LIKE '%.rs' THEN 'cargo' END AS framework
    FROM paired""",
)
def test_coverage(spark, d):
    own = F.expr("CAST(IF(id % 10 = 3, 1, 0) AS BIGINT)")
    met = resolve.test_coverage(_files(spark, d).select("path", own.alias("own")), made(spark, d, TESTS))
    return met.withColumn("framework", mining.test_framework(F.col("test_path")))


@Q.add(
    "J12_G18_calls",
    f"""{WITH_FILES}, calls AS (SELECT id, path, 'm::x.go' || (id % 6) AS callee, 'go' || (id % 6) AS name FROM files WHERE id % 2 = 0),
    index AS (SELECT id AS ord, 'go' || (id % 9) AS name, path, folder || '::go' || (id % 9) || '#' || id AS target FROM files WHERE id % 4 <> 1),
    ranked AS (SELECT c.id, c.callee, i.target, row_number() OVER (PARTITION BY c.id ORDER BY c.path = i.path DESC, i.ord) AS r FROM calls c JOIN index i USING (name))
    SELECT id, callee, target FROM ranked WHERE r = 1""",
)
def calls(spark, d):
    files = _files(spark, d)
    said = files.filter("id % 2 = 0").select("id", F.col("path").alias("file_path"), F.expr("concat('m::x.go', id % 6)").alias("callee"))
    index = files.filter("id % 4 <> 1").select(
        F.expr("concat('go', id % 9)").alias("name"), F.expr("concat(folder, '::go', id % 9, '#', id)").alias("qualified_name"),
        F.col("path").alias("file_path"), F.col("id").alias("ord"),
    )
    return resolve_calls(said, index)


@Q.add(
    "G19_symbols",
    f"""{WITH_FILES}
    SELECT path, CASE WHEN extension = 'rs' THEN (CASE id % 3 WHEN 0 THEN 'm1::load' WHEN 1 THEN 'm' || (id % 4) || '::f' || id || '::load' ELSE 'm' || (id % 4) || '::load' END)
      WHEN extension = 'py' THEN (CASE id % 3 WHEN 0 THEN 'src.m' || (id % 4) || '.load' WHEN 1 THEN 'src.load' ELSE 'os.path' END)
      ELSE (CASE id % 3 WHEN 0 THEN folder || '/load' WHEN 1 THEN 'src/app/load' ELSE 'lib/load' END) END AS symbol
    FROM files WHERE extension <> 'md'""",
)
def symbols(spark, d):
    said = F.expr("""CASE WHEN extension = 'rs' THEN element_at(array('crate::m1::load', 'self::load', 'super::load'), CAST(id % 3 AS INT) + 1)
      WHEN extension = 'py' THEN element_at(array('.load', '..load', 'os.path'), CAST(id % 3 AS INT) + 1)
      ELSE element_at(array('./load.ts', '../app/load', '@/load'), CAST(id % 3 AS INT) + 1) END""")
    rows = _files(spark, d).filter("extension <> 'md'").withColumn("said", said)
    return rows.select("path", resolve.canonical_symbol(F.col("extension"), F.col("path"), F.col("said"), {"@/": "lib/"}).alias("symbol"))


@Q.add(
    "S8_M12_dependencies",
    """WITH deps AS (SELECT 's' || s_suppkey || '/' || CASE s_suppkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' ELSE 'Cargo.toml' END AS path,
        'lib' || (s_suppkey % 7) AS package, '1.' || (s_suppkey % 4) AS version, false AS is_dev FROM supplier
      UNION ALL SELECT 's' || s_suppkey || '/' || CASE s_suppkey % 3 WHEN 0 THEN 'package.json' ELSE 'Cargo.toml' END, 'kit', '2.0', true FROM supplier WHERE s_suppkey % 3 <> 1
      UNION ALL SELECT 's' || s_suppkey || '/requirements.txt', 'other', '3', false FROM supplier WHERE s_suppkey % 3 = 1)
    SELECT path, package, version, is_dev, CASE WHEN package = 'lib3' AND version = '1.3' THEN 'high' WHEN package = 'kit' THEN 'low' END AS severity FROM deps""",
)
def dependencies(spark, d):
    deps = S.manifest_dependencies(made(spark, d, MANIFESTS))
    known = spark.createDataFrame([("lib3", "1.3", "high"), ("kit", "2.0", "low"), ("lib3", "9.9", "high")], "package string, version string, severity string")
    return deps.join(F.broadcast(known), ["package", "version"], "left").select("path", "package", "version", "is_dev", "severity")


@Q.add(
    "S9_S10_markdown",
    f"""{WITH_FILES} SELECT path, s.pos, s.title, s.level, length(s.body)::BIGINT AS body, 1::BIGINT AS links FROM (
      SELECT path, unnest([{{'pos': 0::BIGINT, 'level': 1::BIGINT, 'title': 'Part ' || id, 'body': 'See `src/m' || (id % 4) || '/f' || (id + 15) || '.md` and [it](src/none/x' || id || '.md).'}},
        {{'pos': 1, 'level': 2, 'title': 'Use', 'body': 'Call it.'}}, {{'pos': 2, 'level': 2, 'title': 'Limits', 'body': CASE WHEN id % 2 = 0 THEN 'None known.' ELSE '' END}}]) AS s
      FROM files WHERE extension = 'md')""",
)
def markdown(spark, d):
    docs = _files(spark, d).filter("extension = 'md'")
    links = S.markdown_parts(docs, "path").select("path", F.size("links").cast("long").alias("links"))
    long = lambda c: F.col(c).cast("long").alias(c)
    found = S.sections(docs, "path").select("path", long("pos"), "title", long("level"), F.length("body").cast("long").alias("body"))
    return found.join(links, "path")


@Q.add(
    "S5_syntax",
    f"{WITH_FILES} SELECT path, 2::BIGINT AS symbols FROM files WHERE extension = 'py'",
)
def syntax(spark, d):
    found = S.syntax_graph(_files(spark, d).filter("extension = 'py'").select("path", "text"))
    return found.filter("record = 'node' AND kind IN ('class', 'function')").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))


#: Which files each rule finds something in, once each, by how the made tree is written.
FIRES = {
    "ts.any-annotation": f"{SCRIPT} AND id % 3 = 0", "ts.as-any": f"{SCRIPT} AND id % 4 = 0", "ts.untyped-param": SCRIPT,
    "security.dynamic-eval": f"{SCRIPT} AND id % 6 = 0", "security.openai-key": f"{SCRIPT} AND id % 7 = 0", "security.sql-concat": f"{SCRIPT} AND id % 9 = 0",
    "security.unchecked-handler": f"{SCRIPT} AND id % 15 = 0", "security.rust-unsafe": "extension = 'rs' AND id % 3 = 0",
    "a11y.img-alt": "extension = 'tsx' AND id % 12 = 0", "a11y.icon-button": "extension = 'tsx' AND id % 12 = 1", "a11y.button-focus": "extension = 'tsx' AND id % 12 = 1",
    "theme.missing-dark-variant": "extension = 'tsx' AND id % 13 = 0", "perf.effect-without-deps": f"{SCRIPT} AND id % 10 = 0",
    "perf.many-state-updates": f"{SCRIPT} AND id % 11 = 0", "perf.array-from-in-loop": f"{SCRIPT} AND id % 14 = 0", "perf.unwrap-in-async": "extension = 'rs' AND id % 4 = 0",
}
FINDINGS = " UNION ALL ".join(f"SELECT path, '{rule}' AS rule_id FROM files WHERE {where}" for rule, where in FIRES.items())


@Q.add("C1_C2_C3_C4_C5_C12_findings", f"{WITH_FILES} {FINDINGS}")
def findings(spark, d):
    docs = made(spark, d, FILES, spread=True).withColumn("doc_key", F.col("path"))
    found = audit.scan(docs, audit.CODE_RULES + audit.CODE_CHECKS, extension="extension")
    return found.select(F.col("doc_key").alias("path"), "rule_id")


@Q.add("C1_C5_scan_text", f"{WITH_FILES} {FINDINGS}")
def findings_by_table_function(spark, d):
    """The same through SQL: a table function in a LATERAL join."""
    audit.register(spark)
    return spark.sql("SELECT f.path, s.rule_id FROM {files} f, LATERAL scan_text(f.text, f.extension, 'code') s", files=made(spark, d, FILES, spread=True))


@Q.add(
    "C7_channels",
    """WITH declared AS (SELECT 'load' || (3 * n_nationkey + 1) AS channel FROM nation UNION SELECT 'c' || (3 * n_nationkey) FROM nation UNION SELECT 'building' FROM nation),
    c AS (SELECT c_custkey AS id, lower(c_mktsegment) AS segment FROM customer),
    said AS (SELECT id, 'ipc.handler-not-in-types' AS rule_id, 'warning' AS severity, segment AS channel, 1 AS line FROM c WHERE id % 3 = 0
      UNION ALL SELECT id, 'ipc.handler-not-in-types', 'warning', 'c' || id, 3 FROM c WHERE id % 3 = 0
      UNION ALL SELECT id, 'ipc.handler-not-in-types', 'warning', 'Upper', 4 FROM c WHERE id % 3 = 0
      UNION ALL SELECT id, 'ipc.unknown-channel', 'error', 'load' || id, 1 FROM c WHERE id % 3 = 1
      UNION ALL SELECT id, 'ipc.unknown-channel', 'error', segment, 2 FROM c WHERE id % 3 = 1
      UNION ALL SELECT id, 'ipc.unknown-channel', 'error', 'done', 4 FROM c WHERE id % 3 = 1
      UNION ALL SELECT id, 'ipc.unknown-channel', 'error', 'gone' || id, 3 FROM c WHERE id % 3 = 2)
    SELECT 'app/c' || id || '.ts' AS path, rule_id, severity, channel, line FROM said WHERE channel NOT IN (SELECT channel FROM declared)""",
)
def channels(spark, d):
    """Scripts of a process with windows: what they call and handle, against the types of channels."""
    scripts = made(spark, d, CHANNEL_SCRIPTS).select(F.col("path").alias("doc_key"), F.lit("ts").alias("extension"), "text")
    found = audit.channel_findings(scripts, audit.declared_channels(made(spark, d, CHANNEL_TYPES)))
    return found.withColumnRenamed("doc_key", "path")


@Q.add(
    "C8_markdown_drift",
    f"""{WITH_FILES}, said AS (SELECT path AS doc_key, 'src/m' || (id % 4) || '/f' || (id + 15) || '.md' AS path FROM files WHERE extension = 'md'
      UNION ALL SELECT path, 'src/none/x' || id || '.md' FROM files WHERE extension = 'md')
    SELECT * FROM said WHERE path NOT IN (SELECT path FROM files)""",
)
def markdown_drift(spark, d):
    return audit.dead_links(_docs(spark, d).filter("extension = 'md'"), _files(spark, d))


NAME = "CASE WHEN id % 5 = 0 THEN 'read_' ELSE 'read' END || CASE WHEN id % 2 = 0 THEN 'All' ELSE 'all' END || id"


@Q.add(
    "C9_refactor",
    f"""{WITH_FILES} SELECT 'unreachable' AS rule, path, {NAME} AS name FROM files WHERE {SCRIPT} AND id % 4 <> 1
    UNION ALL SELECT 'unreachable', path, 'store' || id FROM files WHERE extension = 'rs'
    UNION ALL SELECT 'unreferenced', path, 'Shape' || id FROM files WHERE {SCRIPT} AND id % 16 = 0
    UNION ALL SELECT 'unreferenced', path, 'Part' || id FROM files WHERE extension = 'py'
    UNION ALL SELECT 'rename', path, {NAME} FROM files WHERE {SCRIPT} AND id % 5 = 0""",
)
def refactor(spark, d):
    docs = _docs(spark, d)
    tag = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("doc_key").alias("path"), "name")
    # `run` and `go` are declared in many files, so they stand more than once.
    return tag("unreachable", audit.unreachable_functions(docs)).union(tag("unreferenced", audit.unreferenced_types(docs))).union(tag("rename", audit.renames(docs)))


@Q.add("C9_unused_imports", f"{WITH_FILES} SELECT path, 'load' || id AS name FROM files WHERE {SCRIPT} AND id % 17 = 0")
def unused_imports(spark, d):
    return audit.unused_imports(_docs(spark, d)).select(F.col("doc_key").alias("path"), "name")


@Q.add(
    "M1_observations",
    f"""{WITH_FILES} SELECT path, (CASE extension WHEN 'md' THEN 0 WHEN 'rs' THEN CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END ELSE 1 END)::BIGINT AS functions,
      (CASE WHEN extension = 'py' OR {SCRIPT} AND id % 16 = 0 THEN 1 ELSE 0 END)::BIGINT AS types,
      (CASE WHEN extension = 'md' THEN 0 ELSE 1 END)::BIGINT AS imports, 0::BIGINT AS exports, false AS is_test FROM files""",
)
def observations(spark, d):
    return mining.observed(_files(spark, d))


@Q.add(
    "M1_M4_violations",
    f"""{WITH_FILES}, names AS (SELECT extension AS scope, CASE WHEN id % 25 = 0 THEN 'read_all' ELSE 'readAll' END || id AS name,
      CASE WHEN id % 25 = 0 THEN 'snake' ELSE 'camel' END AS style FROM files WHERE {SCRIPT}), n AS (SELECT scope, style, count(*) AS n, sum(count(*)) OVER (PARTITION BY scope) AS total FROM names GROUP BY 1, 2),
    c AS (SELECT scope, style AS expected FROM n WHERE total >= 3 AND n / total >= 0.8)
    SELECT name, scope, expected, style AS found FROM names JOIN c USING (scope) WHERE style <> expected""",
)
def violations(spark, d):
    name = F.expr("concat(CASE WHEN id % 25 = 0 THEN 'read_all' ELSE 'readAll' END, id)")
    rows = _files(spark, d).filter(SCRIPT).select(F.col("extension").alias("scope"), name.alias("name"))
    return mining.violations(rows, mining.naming_conventions(rows, "scope", "name"), "scope", "name").select("name", "scope", "expected", "found")


@Q.add(
    "M5_M7_M8_intents",
    f"""{WITH_FILES}, claims AS (
      SELECT path AS file, CASE WHEN {SCRIPT} THEN 'frozen' ELSE 'deprecated' END AS intent, 0 AS rank FROM files WHERE {SCRIPT} AND id % 8 = 0 OR extension = 'py' AND id % 7 = 0
      UNION ALL SELECT path, 'experimental', 1 FROM files WHERE id % 10 = 4
      UNION ALL SELECT path, CASE WHEN folder = 'src/m3' THEN 'frozen' ELSE 'deferred' END, 2 FROM files WHERE folder = 'src/m3' OR extension = 'rs')
    SELECT file, arg_min(intent, rank) AS intent FROM claims GROUP BY 1""",
)
def intents(spark, d):
    files = _files(spark, d).withColumnRenamed("path", "file")
    said = mining.annotated_intents(files).select("file", "intent", F.lit(0).alias("rank"))
    lines = files.filter("id % 10 = 4").groupBy(F.col("id") % 3).agg(F.array_join(F.collect_list(F.concat(F.lit("- "), "file", F.lit(": experimental - new"))), "\n").alias("text"))
    told = mining.written_intents(lines).select("file", "intent", F.lit(1))
    ruled = mining.glob_intents(files, [("src/m3/**", "frozen"), ("**/*.rs", "deferred")]).select("file", "intent", F.lit(2))
    return mining.first_claim(said.union(told).union(ruled), "file", ["rank"]).select("file", "intent")


@Q.add(
    "R9_R10_embed_backlog",
    f"""{WITH_FILES}, anchors AS (SELECT path, folder || '::' || CASE WHEN extension = 'rs' THEN 'Stores part ' || id || '.' ELSE extension || ' file' END AS anchor, id FROM files WHERE extension <> 'md')
    SELECT anchor, min(path) AS path FROM anchors WHERE id % 3 <> 0 GROUP BY 1""",
)
def backlog(spark, d):
    files = _files(spark, d)
    what = F.when(F.col("extension") == "rs", resolve.doc_summary(F.col("text"), F.col("path"))).otherwise(F.concat("extension", F.lit(" file")))
    anchors = files.filter("extension <> 'md'").select("id", "path", F.concat_ws("::", "folder", what).alias("anchor"))
    done = anchors.filter("id % 3 = 0").select("id")
    return orphans(anchors, "id", done, "id").groupBy("anchor").agg(F.min("path").alias("path"))


@Q.add(
    "R35_summaries",
    f"""{WITH_FILES} SELECT path, CASE WHEN {SCRIPT} THEN 'Reads part ' || id || '.' WHEN extension = 'rs' THEN 'Stores part ' || id || '.'
      WHEN extension = 'py' THEN 'Defines class Part' || id || '.' ELSE path END AS summary FROM files""",
)
def summaries(spark, d):
    return _files(spark, d).select("path", resolve.doc_summary(F.col("text"), F.col("path")).alias("summary"))


@Q.add(
    "R23_shapes",
    f"""{WITH_FILES} SELECT extension, substr(array_to_string(regexp_extract_all(text, '\\b(?:{"|".join(resolve.SHAPE_WORDS)})\\b|[{{}}()\\[\\];]'), ' '), 1, 512) AS shape,
      count(*) AS n FROM files GROUP BY 1, 2""",
)
def shapes(spark, d):
    """How many files of a language have each shape."""
    return _files(spark, d).groupBy("extension", resolve.shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


@Q.add(
    "R36_wiki_pages",
    f"""{WITH_FILES} SELECT replace(folder, '/', '-') AS slug, 'Holds ' || count(*) || ' files of ' || count(DISTINCT extension) || ' kinds.' AS purpose,
      CASE WHEN count(*) FILTER (id % 7 = 0) / count(*) >= 0.75 THEN 'high' WHEN count(*) FILTER (id % 7 = 0) / count(*) >= 0.4 THEN 'medium' ELSE 'low' END AS risk,
      list_sort(list(path)) AS files FROM files GROUP BY folder""",
)
def wiki(spark, d):
    share = F.count_if(F.col("id") % 7 == 0) / F.count("*")
    return _files(spark, d).groupBy("folder").agg(
        F.format_string("Holds %d files of %d kinds.", F.count("*"), F.countDistinct("extension")).alias("purpose"),
        F.when(share >= 0.75, "high").when(share >= 0.4, "medium").otherwise("low").alias("risk"), F.sort_array(F.collect_list("path")).alias("files"),
    ).select(F.replace("folder", F.lit("/"), F.lit("-")).alias("slug"), "purpose", "risk", "files")


@Q.add(
    "R37_identity",
    """WITH kinds AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'python' ELSE 'rust' END AS stack, 'lib' || (s_suppkey % 7) AS package FROM supplier)
    SELECT stack, count(*) AS manifests, count(DISTINCT package) AS packages FROM kinds GROUP BY 1""",
)
def identity(spark, d):
    manifests = made(spark, d, MANIFESTS)
    stack = F.when(F.col("path").endswith("package.json"), "node").when(F.col("path").endswith("requirements.txt"), "python").when(F.col("path").endswith("Cargo.toml"), "rust")
    deps = S.manifest_dependencies(manifests).filter("package LIKE 'lib%'")
    return manifests.join(deps.select("path", "package"), "path", "left").groupBy(stack.alias("stack")).agg(F.countDistinct("path").alias("manifests"), F.countDistinct("package").alias("packages"))


@Q.add(
    "R32_R40_skills",
    """WITH s AS (SELECT 'part-' || p_partkey AS name, list_distinct(string_split(lower(p_name), ' ')) AS triggers, [lower(p_type), 'size' || p_size] AS tags FROM part),
    asked AS (SELECT ['how', 'do', 'i', 'fit', 'a', 'red', 'widget', 'economy', 'size7'] AS words),
    scored AS (SELECT name, (2 * len(list_intersect(triggers, words)) + len(list_intersect(tags, words)))::INT AS score FROM s, asked)
    SELECT name, score, CASE WHEN score >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM scored WHERE score > 0 ORDER BY score DESC, name LIMIT 20""",
)
def skills(spark, d):
    """Each part is a skill: the words of its name trigger it, its type and size are its tags."""
    from lodegraph.operators.ledger import skill_scores

    tags = F.array("p_type", F.concat(F.lit("size"), F.col("p_size").cast("string")))
    rows = table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.split("p_name", " ").alias("triggers"), tags.alias("tags"))
    return skill_scores("How do I fit a RED widget economy size7", rows, 20).select("name", "score", "confidence")


@Q.add(
    "S16_exports",
    f"""WITH nodes AS ({NODES}), edges AS ({CONTAINMENT})
    SELECT 'graphml' AS format, '<node id="' || qualified_name || '"><data key="kind">' || kind || '</data></node>' AS value FROM nodes
    UNION ALL SELECT 'graphml', '<edge source="' || source || '" target="' || target || '"><data key="kind">' || kind || '</data></edge>' FROM edges
    UNION ALL SELECT 'cypher', 'CREATE (:Node {{id: ' || chr(39) || qualified_name || chr(39) || ', kind: ' || chr(39) || kind || chr(39) || '}});' FROM nodes
    UNION ALL SELECT 'cypher', 'MATCH (a {{id: ' || chr(39) || source || chr(39) || '}}), (b {{id: ' || chr(39) || target || chr(39) || '}}) CREATE (a)-[:' || upper(kind) || ']->(b);' FROM edges
    UNION ALL SELECT 'jsonld', '{{"@id":"' || qualified_name || '","@type":"' || kind || '","name":"' || name || '"}}' FROM nodes
    UNION ALL SELECT 'jsonld', '{{"@id":"' || source || '","relation":"' || kind || '","target":"' || target || '"}}' FROM edges""",
)
def exports(spark, d):
    from lodegraph.sources.tables import containment_edges, nodes

    n, e = nodes(spark, d), containment_edges(spark, d)
    of = {"graphml": S.graphml_rows, "cypher": S.cypher_rows, "jsonld": S.jsonld_rows}
    parts = [rows(n, e).select(F.lit(name).alias("format"), "value") for name, rows in of.items()]
    return parts[0].union(parts[1]).union(parts[2])


@Q.add(
    "S7_git_log",
    """SELECT 'c' || o_orderkey AS sha, sum(l_linenumber)::BIGINT AS additions, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def git_log(spark, d):
    lines = table(spark, d, "lineitem")
    value = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.lit("-"), F.concat(F.lit("p"), "l_partkey"))
    found = S.commit_files(lines.select(F.concat(F.lit("c"), "l_orderkey").alias("sha"), value.alias("value")))
    return found.groupBy("sha").agg(F.sum("additions").alias("additions"), F.count("*").alias("files"))
