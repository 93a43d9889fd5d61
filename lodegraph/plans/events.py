"""Queries of the ledger and stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import ledger
from lodegraph.plans.registry import Registry
from lodegraph.sources.tables import table
from lodegraph.streaming import bus

Q = Registry()


def _turns(spark, d):
    return table(spark, d, "conversations").withColumnRenamed("conv_id", "session")


def _topics(spark, d):
    topic = F.concat(F.lit("project."), F.col("user_id") % 7, F.lit("."), "event_type")
    return table(spark, d, "events").withColumn("topic", topic)


@Q.add(
    "R29_conversation_search",
    """SELECT conv_id AS session, turn, role FROM conversations WHERE contains(lower(text), 'the')
      ORDER BY turn DESC, conv_id LIMIT 50""",
)
def conversation_search(spark, d):
    return ledger.search_turns(_turns(spark, d), "the").select("session", "turn", "role")


@Q.add(
    "R30_decision_search",
    """SELECT conv_id AS session, turn FROM conversations WHERE role = 'assistant' AND turn >= 1
      AND contains(lower(text), 'der') ORDER BY turn DESC, conv_id LIMIT 20""",
)
def decision_search(spark, d):
    return ledger.search_turns(_turns(spark, d).filter("role = 'assistant' AND turn >= 1"), "der", limit=20).select("session", "turn")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SAID, ASKED = "coalesce(text, '')", "coalesce(asked, '')"
KIND = " ".join(
    f"WHEN {test} THEN '{kind}'" for kind, test in (
        ("open_question", f"regexp_matches(trim({SAID}), {_sql(ledger.QUESTION)})"),
        ("decision", f"regexp_matches({SAID}, {_sql(ledger.DECISION)}) OR regexp_matches({SAID}, {_sql(ledger.DECISION_OVER)})"),
        ("bug", f"regexp_matches({ASKED}, {_sql(ledger.BUG)}) OR regexp_matches({SAID}, {_sql(ledger.BUG)})"),
        ("refactor", f"regexp_matches({SAID}, {_sql(ledger.REFACTOR)})"),
        ("experiment", f"regexp_matches({SAID}, {_sql(ledger.EXPERIMENT)})"),
    )
)


@Q.add(
    "R31_distilled",
    f"""WITH t AS (SELECT conv_id AS session, turn, role, text, CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END AS asked FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT session, turn, CASE {KIND} ELSE 'impl' END AS kind,
      CASE WHEN regexp_extract(text, {_sql(ledger.FIRST_SENTENCE)}) <> '' THEN trim(regexp_extract(text, {_sql(ledger.FIRST_SENTENCE)})) ELSE trim(text[1:160]) END AS summary,
      nullif(trim(regexp_extract(text, {_sql(ledger.RATIONALE)}, 1)), '') AS rationale,
      len(list_distinct(list_filter(regexp_extract_all(concat_ws(chr(10), {ASKED}, text), {_sql(ledger.FILE_PATH)}), lambda x: length(x) >= 3))) AS touched_files
    FROM t WHERE role = 'assistant'""",
)
def distilled(spark, d):
    return ledger.distill(_turns(spark, d)).withColumn("touched_files", F.size("touched_files"))


@Q.add(
    "L4_L5_resume",
    """SELECT section, session, count(*) AS n, max(turn) AS newest FROM (SELECT 'timeline' AS section, conv_id AS session, turn,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, 3 AS most
      FROM conversations UNION ALL SELECT role, conv_id, turn, row_number() OVER (PARTITION BY conv_id, role
      ORDER BY turn DESC), 2 FROM conversations WHERE role IN ('user', 'assistant'))
      WHERE r <= most GROUP BY 1, 2""",
)
def resume(spark, d):
    entries = _turns(spark, d).withColumn("kind", F.col("role")).withColumn("summary", F.substring("text", 1, 80))
    met = ledger.resume(entries, sizes={"timeline": 3, "user": 2, "assistant": 2})
    return met.groupBy("section", "session").agg(F.count("*").alias("n"), F.max("turn").alias("newest"))


@Q.add(
    "L2_recall",
    """WITH h AS (SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 5)
      SELECT event_id FROM events WHERE event_id IN (FROM h) OR event_id IN (SELECT event_id
      FROM events ORDER BY ts DESC, event_id LIMIT 40) ORDER BY (event_id IN (FROM h)) DESC, ts DESC, event_id LIMIT 10""",
)
def recall(spark, d):
    e = table(spark, d, "events")
    hits = e.filter("event_type = 'purchase'").orderBy(F.desc("value"), "event_id").limit(5)
    return ledger.recall(e, "event_id", "ts", hits, 10).select("event_id")


@Q.add(
    "L2_semantic_recall",
    """WITH asked AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
      ids AS (SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 40)
        UNION SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') ORDER BY doc_id DESC LIMIT 40)),
      scored AS (SELECT doc_id, coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0) AS s FROM documents LEFT JOIN embeddings ON vec_id = doc_id, asked WHERE doc_id IN (FROM ids))
      SELECT doc_id, round(s, 6) AS score FROM scored ORDER BY s DESC, doc_id DESC LIMIT 10""",
)
def semantic_recall(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 7").select("embedding").first().embedding
    docs = table(spark, d, "documents")
    entries = docs.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    hits = docs.filter(F.contains(F.lower("text"), F.lit("tion the")))
    found = ledger.semantic_recall(entries, "doc_id", "doc_id", "embedding", asked, hits, 10)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@Q.add(
    "L14_first_of",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""",
)
def goal(spark, d):
    o = table(spark, d, "orders")
    newest = lambda c: o.filter(c).orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey")
    return ledger.first_of([newest("o_orderstatus = 'none'"), newest("o_orderstatus = 'P'"), newest("o_orderstatus = 'O'")])


@Q.add(
    "L11_snapshot_compare",
    """SELECT count(*) FILTER (a.k IS NULL) AS added, count(*) FILTER (b.k IS NULL) AS removed, count(*) FILTER (a.v <> b.v) AS modified
      FROM (SELECT doc_id AS k, n_chars AS v FROM documents WHERE doc_id % 9 <> 0) a FULL
      JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS v
      FROM documents WHERE doc_id % 5 <> 0) b ON a.k = b.k""",
)
def compare(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    new = docs.filter("doc_id % 5 <> 0").withColumn("n_chars", F.expr("IF(doc_id % 4 = 0, n_chars + 1, n_chars)"))
    return ledger.net_changes(docs.filter("doc_id % 9 <> 0"), new, "doc_id", "n_chars")


@Q.add(
    "L17_recent_calls",
    """SELECT user_id, bool_or(event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY) AS did
      FROM events GROUP BY 1""",
)
def recent_calls(spark, d):
    e = table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    met = e.join(now, F.col("ts") <= F.col("now"))
    did = (F.col("event_type") == "purchase") & (F.col("ts") >= F.col("now") - F.expr("INTERVAL 2 DAYS"))
    return met.groupBy("user_id").agg(F.bool_or(did).alias("did"))


@Q.add("L15_T5_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def payload(spark, d):
    met = bus.decode(table(spark, d, "events").withColumn("kind", F.lit("event")), "props", {"event": "k bigint"}, "kind")
    return met.select("event_id", F.col("event.k").alias("k"))


@Q.add(
    "T2_T3_topics",
    """SELECT 'project.' || (user_id % 7) || '.' || event_type AS topic, count(*) AS n FROM events
      WHERE event_type = 'click' AND user_id % 7 <> 3 OR user_id % 7 = 3 GROUP BY 1""",
)
def topics(spark, d):
    e = _topics(spark, d).filter(bus.valid_topic(F.col("topic")))
    both = e.filter(F.col("topic").rlike(bus.topic_pattern("project.*.click")) | F.col("topic").rlike(bus.topic_pattern("project.3.#")))
    return both.groupBy("topic").agg(F.count("*").alias("n"))


@Q.add(
    "T6_rates",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(count(*) / 3600, 9) AS per_second
      FROM events GROUP BY 1, 2""",
)
def rates(spark, d):
    return bus.rates(table(spark, d, "events"), "ts", "1 hour", 3600, "event_type").withColumn("per_second", F.round("per_second", 9))


@Q.add(
    "T7_debounce",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new
      FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst
      FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b
      GROUP BY user_id, burst""",
)
def debounce(spark, d):
    return bus.debounce(table(spark, d, "events"), "user_id", "ts", "event_type", "2 hours").select("user_id", "first", "last", "n")


@Q.add(
    "T11_tail",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
      FROM events) WHERE r <= 3""",
)
def tail(spark, d):
    return bus.tail(table(spark, d, "events"), "user_id", "event_id", 3).select("user_id", "event_id")


@Q.add("T13_changed_only", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.xxhash64("text").alias("digest"))
    known = docs.withColumn("digest", F.expr("IF(path % 3 = 0, digest + 1, digest)"))
    return bus.changed_only(docs, known).select(F.col("path").alias("doc_id"))
