"""Queries of the text, vector, fingerprint, audit and mining operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import names, sketch
from lodegraph.operators import audit, mining, text
from lodegraph.operators.graph import degrees, saved, strong_components
from lodegraph.plans.registry import GRAPH, NODES, ORDER_EDGES, Registry
from lodegraph.sources.code import FILES, for_sql, made
from lodegraph.sources.tables import edges, nodes, order_edges, table

Q = Registry()
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: strlen(x) >= 2)"
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@Q.add("R1_tokens", f"SELECT doc_id, len({TOKENS}) AS n, list_distinct({TOKENS}).len() AS different FROM documents")
def tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("different"))


@Q.add(
    "R2_postings",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf
      FROM t GROUP BY 1""",
)
def postings(spark, d):
    p = text.postings(table(spark, d, "documents"), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@Q.add(
    "R3_R6_bm25",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS m
      FROM t), q AS (SELECT unnest(['ther', 'and', 'the', 'der', 'the']) AS w), df AS (SELECT w, count(*) AS df
      FROM (SELECT DISTINCT w FROM q) JOIN t ON list_contains(t, w) GROUP BY 1), x AS (SELECT doc_id, q.w, len(list_filter(t,
      lambda y: y = q.w)) AS tf, len(t) AS l FROM t, q) SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 /
      (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) AS score FROM x JOIN df USING (w), s
      WHERE tf > 0 GROUP BY 1 ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m)))
      DESC, doc_id LIMIT 20""",
)
def bm25(spark, d):
    return text.bm25(table(spark, d, "documents"), "ther and the der the", "doc_id", limit=20).withColumn("score", F.round("score", 6))


@Q.add(
    "R4_full_text",
    f"""SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda x: x[1:3] = 'the')) > 0
      AND len(list_filter({TOKENS}, lambda x: x[1:2] = 'ou')) > 0""",
)
def full_text(spark, d):
    return text.full_text(table(spark, d, "documents"), "the ou", "doc_id", prefix=True)


@Q.add("R5_L3_fallback", "SELECT doc_id FROM documents WHERE contains(lower(text), 'oken =')")
def fallback(spark, d):
    docs = table(spark, d, "documents")
    return text.or_else(text.full_text(docs, "zzzzzzzz", "doc_id"), docs.filter(F.lower("text").contains("oken =")).select("doc_id"))


COSINE = "list_inner_product(a.embedding, b.embedding) / sqrt(list_inner_product(a.embedding, a.embedding)) / sqrt(list_inner_product(b.embedding, b.embedding))"


@Q.add(
    "R11_R12_R13_nearest",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings), c AS (SELECT a.vec_id, list_cosine_similarity(a.embedding, b.embedding) AS score
      FROM e a, (SELECT embedding FROM e WHERE vec_id = 7) b WHERE a.label < 8)
    SELECT vec_id, round(score, 6) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 20""",
)
def nearest(spark, d):
    v = table(spark, d, "embeddings")
    at = v.filter("vec_id = 7").select("embedding").first().embedding
    found = text.nearest(v, at, "vec_id", "embedding", 20, F.col("label") < 8)
    return found.withColumn("score", F.round("score", 6))


def _spread(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END"


@Q.add(
    "R14_R15_fusion",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS m FROM t), q AS (SELECT unnest(['ther', 'and']) AS w),
    df AS (SELECT w, count(*) AS df FROM q JOIN t ON list_contains(t, w) GROUP BY 1),
    x AS (SELECT doc_id, q.w, len(list_filter(t, lambda y: y = q.w)) AS tf, len(t) AS l FROM t, q),
    a AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))) AS score
      FROM x JOIN df USING (w), s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 30),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings),
    b AS (SELECT a.vec_id AS doc_id, list_cosine_similarity(a.embedding, b.embedding) AS score FROM e a, (SELECT embedding FROM e WHERE vec_id = 3) b ORDER BY score DESC, doc_id LIMIT 30),
    c AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS score FROM documents WHERE contains(lower(text), 'the') ORDER BY score DESC, doc_id LIMIT 30),
    r AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part, 'bm25' AS source FROM a
      UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 'vector' FROM b
      UNION ALL SELECT doc_id, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 'graph' FROM c),
    f AS (SELECT doc_id, sum(part) AS score, list_sort(list(DISTINCT source)) AS sources FROM r GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 25),
    j AS (SELECT f.doc_id, f.score, sources, a.score AS second FROM f LEFT JOIN a USING (doc_id))
    SELECT doc_id, round(score, 9) AS score, sources, round(second, 9) AS second, round(0.5 * {_spread("score")} + 0.5 * coalesce({_spread("second")}, {_spread("score")}), 9) AS blend FROM j""",
)
def fusion(spark, d):
    docs, v = table(spark, d, "documents"), table(spark, d, "embeddings")
    a = text.bm25(docs, "ther and", "doc_id", limit=30)
    b = text.nearest(v, v.filter("vec_id = 3").select("embedding").first().embedding, "vec_id", "embedding", 30).withColumnRenamed("vec_id", "doc_id")
    c = text.occurrences(docs, "the", "doc_id", limit=30).withColumnRenamed("n", "score")
    fused = text.fuse([(a, 1.0, "bm25"), (b, 1.0, "vector"), (c, 0.5, "graph")], "doc_id")
    return text.rerank_blend(fused, a, "doc_id").withColumns({x: F.round(x, 9) for x in ("score", "blend", "second")})


@Q.add(
    "R16_W3_packing",
    """WITH RECURSIVE o AS (SELECT source, doc_id, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents),
    f(source, doc_id, rn, rest, cost, kept) AS (SELECT DISTINCT source, NULL::BIGINT, 0::BIGINT, 20000::BIGINT, 0::BIGINT, false FROM documents
      UNION ALL SELECT o.source, o.doc_id, o.rn, CASE WHEN o.cost <= rest THEN rest - o.cost ELSE rest END, o.cost, o.cost <= rest FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
    SELECT source, doc_id, cost AS tokens FROM f WHERE kept""",
)
def packing(spark, d):
    return text.pack_budget(table(spark, d, "documents"), ["source"], "text", "n_chars", "doc_id", 20_000)


@Q.add("R7_hash_embedding")
def hash_embedding(spark, d):
    e = table(spark, d, "documents").select("doc_id", sketch.hash_embedding("text").alias("e"))
    return e.select("doc_id", F.round(F.array_max("e"), 6).alias("largest"), F.size("e").alias("dims"))


def _little(digest: str, n: int) -> str:
    """The first n bytes of a hexadecimal digest as an unsigned number, little end first."""
    return "('0x' || " + " || ".join(f"substr({digest}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"


#: Words with counts, and 64 votes of their hashes.
SIMHASHES = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), x AS (SELECT DISTINCT word, sha256(word) AS x FROM c),
    h AS (SELECT word, {_little("x", 8)} AS h FROM x),
    v AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS votes FROM c JOIN h USING (word), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY 1, 2),
    s AS (SELECT doc_id, sum(CASE WHEN votes > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END) AS u FROM v GROUP BY 1),
    sims AS (SELECT d.doc_id, lang, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END)::BIGINT AS simhash
      FROM documents d LEFT JOIN s USING (doc_id))"""
MINHASHES = f"""m AS (SELECT word, salt, sha256(unhex(printf('%02x000000', salt)) || encode(word)) AS m FROM x, (SELECT unnest(range(128)) AS salt)),
    mins AS (SELECT doc_id, salt, min({_little("m", 4)}) AS least FROM c JOIN m USING (word) GROUP BY 1, 2),
    lists AS (SELECT doc_id, list(least ORDER BY salt) AS mins FROM mins GROUP BY 1),
    prints AS (SELECT doc_id, lang, simhash, coalesce(mins, list_transform(range(128), lambda i: 4294967295::UBIGINT)) AS mins FROM sims LEFT JOIN lists USING (doc_id))"""


@Q.add("R18_R22_simhash", f"WITH {SIMHASHES} SELECT doc_id, simhash FROM sims")
def simhash(spark, d):
    return text.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", sketch.simhash64("text").alias("simhash"))


@Q.add(
    "R19_R20_R21_similar",
    f"""WITH {SIMHASHES}, {MINHASHES}, scored AS (SELECT a.doc_id AS probe, b.doc_id,
      (128 - 2 * bit_count(xor(a.simhash, b.simhash)) + len(list_filter(list_zip(a.mins, b.mins), lambda z: z[1] = z[2]))) / 256 AS score
      FROM prints a JOIN prints b ON a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT probe, doc_id, score, rank FROM ranked WHERE rank <= 5""",
)
def similar(spark, d):
    """One id in a hundred as probes, each against all documents of its language: the five most similar."""
    prints = text.fingerprints(table(spark, d, "documents"), "lang", "doc_id")
    return text.most_similar(prints, F.col("key") % 100 == 0, 5).withColumnRenamed("key", "doc_id")


@Q.add(
    "R24_kinds",
    """SELECT CASE lang WHEN 'de' THEN 'de_file' WHEN 'en' THEN 'en_file' ELSE 'other_file' END AS kind, count(*) AS n
      FROM documents GROUP BY 1""",
)
def kinds(spark, d):
    kind = F.when(F.col("lang").isin("de", "en"), F.concat("lang", F.lit("_file"))).otherwise("other_file")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@Q.add("R25_export", "SELECT doc_id, lang, n_chars FROM documents")
def export(spark, d):
    return table(spark, d, "documents").drop("source", "text")


@Q.add(
    "R34_cold_baseline",
    """SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'ther', ''))) // 4)::BIGINT AS n
      FROM documents WHERE contains(lower(text), 'ther') ORDER BY n DESC, doc_id LIMIT 5""",
)
def cold(spark, d):
    return text.occurrences(table(spark, d, "documents"), "ther", "doc_id")


@Q.add("R38_token_estimate", "SELECT lang, sum(ceil(strlen(text) / 4))::BIGINT AS tokens FROM documents GROUP BY 1")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(names.token_estimate(F.col("text"))).alias("tokens"))


@Q.add(
    "R26_R27_concepts",
    f"""WITH files AS ({for_sql(FILES)}), found AS (
      SELECT path, unnest(['stores', 'part', 'safe']) AS term, 0.55::DOUBLE AS score FROM files WHERE extension = 'rs'
      UNION ALL SELECT path, id::VARCHAR, 0.55 FROM files WHERE extension IN ('rs', 'md') AND id >= 1000
      UNION ALL SELECT path, 'part', 0.55 FROM files WHERE extension = 'md'
      UNION ALL SELECT path, unnest(['part ' || id, 'use', 'limits']), 0.85 FROM files WHERE extension = 'md'
      UNION ALL SELECT path, unnest(CASE WHEN id % 2 = 0 THEN ['open', 'widget', 'open widget'] ELSE ['max', 'size', 'max size'] END), 0.70 FROM files WHERE extension = 'py'
      UNION ALL SELECT path, unnest(['deprecated', 'other']), 0.55 FROM files WHERE extension = 'py' AND id % 7 = 0)
    SELECT * FROM found""",
)
def concepts(spark, d):
    return text.concepts(made(spark, d, FILES).filter("extension IN ('rs', 'md', 'py')"), "path", prose=F.col("extension") == "md")


@Q.add(
    "R33_smart_questions",
    f"""{GRAPH}, mutual AS (SELECT 'p:' || a.p_partkey AS source, 'p:' || b.p_partkey AS target FROM part a JOIN part b ON a.p_partkey // 40 = b.p_partkey // 40
      AND (a.p_partkey % 40 = 0 AND b.p_partkey % 40 = 1 OR a.p_partkey % 40 = 1 AND b.p_partkey % 40 = 0)),
    linked AS (SELECT source, target FROM edges UNION ALL FROM mutual),
    i AS (SELECT target AS q, count(*) AS n FROM linked GROUP BY 1), o AS (SELECT source AS q, count(*) AS n FROM linked GROUP BY 1),
    b AS (SELECT qualified_name, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, length(name) AS span FROM nodes LEFT JOIN i ON i.q = qualified_name LEFT JOIN o ON o.q = qualified_name),
    s AS (SELECT avg(in_degree) AS m1, stddev_pop(in_degree) AS s1, avg(span) AS m2, stddev_pop(span) AS s2,
      greatest(1, list_sort(list(in_degree))[least(floor(0.95 * count(*)), count(*) - 1)::BIGINT + 1]) AS p95 FROM b),
    z AS (SELECT qualified_name, greatest(0, (in_degree - m1) / s1) AS zi, greatest(0, (span - m2) / s2) AS zs, CASE WHEN in_degree >= p95 THEN 1 ELSE 0 END
      + CASE WHEN qualified_name IN (SELECT source FROM mutual) THEN 0.7 ELSE 0 END + CASE WHEN in_degree = 0 AND out_degree = 0 THEN 0.5 ELSE 0 END AS odd FROM b, s),
    c AS (SELECT *, 0.4 * zi + 0.3 * zs + 0.3 * least(1, odd) AS composite FROM z),
    k AS (SELECT 'starter' AS kind, * FROM c WHERE odd = 0 AND zi > 0 UNION ALL SELECT 'deep_dive', * FROM c WHERE zs > 0.5
      UNION ALL SELECT 'anomaly', * FROM c WHERE odd > 0 UNION ALL SELECT 'all', * FROM c WHERE composite >= 0.01),
    r AS (SELECT kind, qualified_name, round(least(1, composite), 6)::DOUBLE AS score FROM k)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, qualified_name) <= 20""",
)
def smart(spark, d):
    """Orders, containment, and pairs of parts that lead to each other; the nodes on cycles are found, not told."""
    pair = table(spark, d, "part").filter("p_partkey % 40 < 2").groupBy(F.expr("p_partkey div 40").alias("pair")).agg(F.sort_array(F.collect_list("p_partkey")).alias("p"))
    ends = pair.filter("size(p) = 2").select(F.explode(F.expr("array(struct(p[0] AS a, p[1] AS b), struct(p[1] AS a, p[0] AS b))")).alias("e"))
    mutual = ends.select(F.concat(F.lit("p:"), "e.a").alias("source"), F.concat(F.lit("p:"), "e.b").alias("target"))
    linked = edges(spark, d).select("source", "target").union(mutual)
    deg = nodes(spark, d).join(degrees(linked), "qualified_name", "left")
    rows = deg.select("qualified_name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.length("name").cast("long").alias("span"))
    scores = saved(text.smart_scores(rows, strong_components(linked).withColumnRenamed("node", "qualified_name")))
    return reduce(DataFrame.union, [text.questions(scores, kind) for kind in ("starter", "deep_dive", "anomaly", "all")])


RULE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{i}' AS rule_id, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for i, _, _, p in audit.PROSE_RULES
)


@Q.add("C6_C10_rule_counts", f"SELECT doc_id, rule_id, n::BIGINT AS n FROM ({RULE_SQL}) WHERE n > 0")
def rule_counts(spark, d):
    return audit.counts(table(spark, d, "documents"), audit.PROSE_RULES, "doc_id")


ANYWHERE = [r for r in audit.CODE_RULES if r[2] is None] + audit.PROSE_RULES
ANYWHERE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{i}' AS rule_id, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM documents" for i, _, _, p in ANYWHERE
)


@Q.add("C3_C6_C12_findings", f"SELECT doc_id::VARCHAR AS doc_key, rule_id, n::BIGINT AS n FROM ({ANYWHERE_SQL}) WHERE n > 0")
def findings(spark, d):
    """Documents have no extension, so rules for any text alone fire; C1_C2_C3_C4_C5_C12_findings runs all over files."""
    docs = table(spark, d, "documents").withColumn("doc_key", F.col("doc_id"))
    return audit.scan(docs, audit.CODE_RULES + audit.PROSE_RULES).groupBy("doc_key", "rule_id").agg(F.count("*").alias("n"))


@Q.add(
    "A10_C13_finding_stats",
    f"""SELECT split_part(rule_id, '.', 1) AS scanner, count(*) AS texts, sum(n)::BIGINT AS n
      FROM ({RULE_SQL}) WHERE n > 0 GROUP BY 1""",
)
def finding_stats(spark, d):
    met = audit.counts(table(spark, d, "documents"), audit.PROSE_RULES, "doc_id")
    return met.groupBy(F.substring_index("rule_id", ".", 1).alias("scanner")).agg(F.count("*").alias("texts"), F.sum("n").alias("n"))


@Q.add(
    "C4_page_links",
    """SELECT page_id, len(regexp_extract_all(html, '<a[^>]*>')) AS anchors, len(regexp_extract_all(html, '<a[^>]*href=[^>]*>')) AS
      with_href FROM pages""",
)
def page_links(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", n("<a[^>]*>").alias("anchors"), n("<a[^>]*href=[^>]*>").alias("with_href"))


@Q.add(
    "C7_C8_dead_references",
    """SELECT p.page_id, h AS href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"#?]*)', 1)) AS h
      FROM pages) p WHERE h NOT IN (SELECT regexp_replace(url, '^https?://[^/]*', '')
      FROM pages)""",
)
def dead_references(spark, d):
    pages = table(spark, d, "pages")
    each = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]*)'), 1))).alias("href"))
    known = pages.select(F.regexp_replace("url", "^https?://[^/]*", "").alias("channel")).distinct()
    return audit.undeclared_channels(each.withColumnRenamed("href", "channel"), known).select("page_id", F.col("channel").alias("href"))


STYLE = "CASE WHEN contains(n, '-') AND NOT contains(n, '_') THEN 'kebab' WHEN contains(n, '_') AND NOT regexp_matches(n, '[a-z]') THEN 'screaming' WHEN contains(n, '_') AND NOT regexp_matches(n, '[A-Z]') THEN 'snake' WHEN contains(n, '_') THEN 'mixed' WHEN regexp_matches(n, '^[A-Z]') AND regexp_matches(n, '[a-z]') THEN 'pascal' WHEN NOT regexp_matches(n, '^[A-Z]') AND regexp_matches(n, '[A-Z]') THEN 'camel' WHEN NOT regexp_matches(n, '[A-Z]') AND n <> '' THEN 'snake' ELSE 'mixed' END"


@Q.add(
    "M2_M3_name_styles",
    f"""WITH w AS (SELECT c_mktsegment AS scope, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) || '_x'
      WHEN 2 THEN c_mktsegment || '_X' ELSE 'a-' || c_custkey END AS n FROM customer)
      SELECT scope, {STYLE} AS style, count(*) AS n FROM w GROUP BY 1, 2""",
)
def name_styles(spark, d):
    n = F.expr("CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat(lower(c_mktsegment), '_x') WHEN 2 THEN concat(c_mktsegment, '_X') ELSE concat('a-', c_custkey) END")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("scope"), names.style(n).alias("style")).agg(F.count("*").alias("n"))


@Q.add(
    "M8_precedence",
    """SELECT o_custkey, o_orderpriority AS intent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def precedence(spark, d):
    rows = table(spark, d, "orders").withColumn("source_rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    return mining.first_claim(rows, "o_custkey", ["source_rank", "o_orderkey"]).select("o_custkey", F.col("o_orderpriority").alias("intent"))


@Q.add(
    "M6_git_intents",
    """WITH c AS (SELECT o_custkey AS file, count(*) AS commits, max(o_orderdate) AS last, sum(o_totalprice) FILTER (o_orderdate >=
      (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY) AS churn FROM orders
      GROUP BY 1) SELECT file, CASE WHEN last < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
      AND commits <= 2 THEN 'frozen' WHEN churn >= 500000 THEN 'deferred' END AS intent
      FROM c WHERE CASE WHEN last < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
      AND commits <= 2 THEN 'frozen' WHEN churn >= 500000 THEN 'deferred' END IS NOT NULL""",
)
def git_intents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("committed_at"), F.col("o_totalprice").alias("lines"))
    now = o.agg(F.max("committed_at").alias("now"))
    return mining.change_intents(o, now, churn=500_000).select("file", "intent")
