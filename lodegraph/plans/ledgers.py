"""Queries of the ledger reads and of publishing, over orders and events as entries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.operators import history as H
from lodegraph.operators.graph import folder
from lodegraph.plans.registry import CONTAINMENT, GRAPH, MEMBERS, NODES, Registry
from lodegraph.sources import files as S
from lodegraph.sources.store import KeyedStore
from lodegraph.sources.tables import containment_edges, membership, nodes, table
from lodegraph.streaming import bus
from lodegraph.streaming.state import STATE_STORE, last_percentiles

Q = Registry()
ENTRIES = """
SELECT o_orderkey AS id, o_orderdate AS made, CASE o_orderkey % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'refactor' ELSE 'impl' END AS kind,
  'moved to ' || o_orderpriority || ' by ' || o_custkey AS text, (o_custkey % 20)::BIGINT AS session FROM orders
"""
EVENTS = "SELECT event_id AS id, ts AS made, event_type || ' of ' || user_id AS text FROM events"


def _entries(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'refactor' ELSE 'impl' END").alias("kind"),
        F.concat(F.lit("moved to "), "o_orderpriority", F.lit(" by "), F.col("o_custkey").cast("string")).alias("text"), (F.col("o_custkey") % 20).alias("session"),
    )


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")).alias("text"))


@Q.add(
    "L6_why",
    f"""SELECT origin, id, made FROM (SELECT 'ledger' AS origin, id, made FROM ({ENTRIES}) WHERE kind <> 'impl' AND contains(lower(text), ' 7')
      UNION ALL SELECT 'commit', id, made FROM ({EVENTS}) WHERE contains(lower(text), ' 7')) ORDER BY made DESC, origin, id LIMIT 20""",
)
def why(spark, d):
    return H.why(_entries(spark, d), _events(spark, d), " 7").select("origin", "id", F.col("at").alias("made"))


@Q.add(
    "L16_history",
    f"""SELECT id, kind FROM ({ENTRIES}) WHERE contains(lower(text), 'urgent') AND made >= TIMESTAMP '1995-01-01'
      ORDER BY made DESC, id LIMIT 50""",
)
def history(spark, d):
    since = F.to_timestamp(F.lit("1995-01-01"))
    return H.history(_entries(spark, d).filter(F.col("at") >= since), "URGENT").select("id", "kind")


@Q.add(
    "L19_recent_of_session",
    f"""SELECT id FROM ({ENTRIES}) WHERE session = 7 AND made >= (SELECT max(o_orderdate)
      FROM orders) - INTERVAL 900 DAY ORDER BY made DESC, id LIMIT 30""",
)
def recent(spark, d):
    e = _entries(spark, d)
    now = F.broadcast(e.agg(F.max("at").alias("now")))  # one row
    rows = e.filter("session = 7").join(now, F.col("at") >= F.col("now") - F.expr("INTERVAL 900 DAYS"))
    return H.history(rows, limit=30).select("id")


@Q.add(
    "L8_constraints",
    f"""SELECT scope, rule_id, id FROM (SELECT *, row_number() OVER (PARTITION BY scope, rule_id ORDER BY made DESC, id) AS r
      FROM (SELECT id, made, kind AS scope, id % 11 AS rule_id FROM ({ENTRIES}))) WHERE r = 1 AND scope IN ('decision', 'impl')""",
)
def constraints(spark, d):
    rows = _entries(spark, d).select("id", "at", F.col("kind").alias("scope"), (F.col("id") % 11).alias("rule_id"))
    return H.in_scope(rows, ["decision", "impl"]).select("scope", "rule_id", "id")


#: Orders in chains of up to 500, of which every other one leads into a cycle of 91.
PARENT = """CASE WHEN o_orderkey % 1000 = 507 THEN o_orderkey + 90 WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_orderkey - 1 END"""


@Q.add(
    "J17_L7_U1_step_tree",
    f"""WITH RECURSIVE s AS (SELECT o_orderkey AS step_id, {PARENT} AS parent FROM orders), t(step_id, root, depth, path) AS (
      SELECT step_id, step_id, 0::BIGINT, step_id::VARCHAR FROM s WHERE parent IS NULL OR parent NOT IN (SELECT step_id FROM s)
      UNION SELECT s.step_id, root, depth + 1, path || '/' || s.step_id FROM t JOIN s ON s.parent = t.step_id),
    lost AS (SELECT * FROM s WHERE step_id NOT IN (SELECT step_id FROM t)),
    w(low, top) AS (SELECT step_id, parent FROM lost UNION SELECT low, parent FROM w JOIN lost ON step_id = top),
    ring AS (SELECT low AS member FROM w WHERE low = top)
    SELECT step_id, root, depth, path, false AS on_cycle FROM t
    UNION ALL SELECT low, min(top) FILTER (top IN (SELECT member FROM ring)), NULL, NULL, low IN (SELECT member FROM ring) FROM w GROUP BY low""",
)
def step_tree(spark, d):
    steps = table(spark, d, "orders").select(F.col("o_orderkey").alias("step_id"), F.expr(PARENT).alias("parent_step_id"))
    return H.step_tree(steps)


PROPOSALS = "SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice AS confidence, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS applied_at FROM orders"


@Q.add(
    "L10_proposals",
    f"""SELECT id, kind FROM ({PROPOSALS}) WHERE applied_at IS NULL AND id % 6 <> 0 AND kind IN ('1-URGENT', '2-HIGH')
      ORDER BY confidence DESC, id LIMIT 100""",
)
def proposals(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("confidence"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("applied_at"),
    )
    done = rows.filter("id % 6 = 0").select("id", F.current_timestamp().alias("at"))
    return H.open_proposals(H.applied(rows, done), ["1-URGENT", "2-HIGH"]).select("id", "kind")


@Q.add(
    "L18_hydration",
    f"""WITH n AS ({NODES}), m AS ({MEMBERS}), q AS (SELECT 'c:' || (p_partkey * 2) AS qualified_name FROM part)
    SELECT q.qualified_name, n.file_path, m.community_id FROM q LEFT JOIN n USING (qualified_name) LEFT JOIN m USING (qualified_name)""",
)
def hydration(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("c:"), (F.col("p_partkey") * 2).cast("string")).alias("qualified_name"))
    return H.hydrated(names, nodes(spark, d), membership(spark, d))


@Q.add(
    "L20_as_of",
    """WITH t AS (SELECT max(o_orderdate) - INTERVAL 700 DAY AS t FROM orders)
    SELECT o_custkey, max(o_orderdate) AS at FROM orders, t WHERE o_orderdate <= t GROUP BY 1""",
)
def as_of(spark, d):
    o = table(spark, d, "orders")
    at = F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 700 DAYS")).alias("t")))  # one row
    rows = o.join(at, F.col("o_orderdate") <= F.col("t"))
    return H.as_of(rows, "o_custkey", "o_orderdate", F.col("t")).select("o_custkey", F.col("o_orderdate").alias("at"))


@Q.add(
    "L12_latest_or_live",
    f"""SELECT 'live' AS origin, (SELECT count(*) FROM ({NODES})) AS nodes, (SELECT count(*)
      FROM ({CONTAINMENT})) AS edges UNION ALL SELECT 'snapshot', 2::BIGINT, 3::BIGINT""",
)
def latest_or_live(spark, d):
    live = nodes(spark, d).agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(containment_edges(spark, d).agg(F.count("*").alias("edges"))))  # one row each
    kept = spark.createDataFrame([(1, 1, 1), (2, 2, 3)], "at long, nodes long, edges long")
    return H.latest_or(kept.limit(0), live).union(H.latest_or(kept, live))


@Q.add(
    "L9_wiki_list",
    "SELECT p_brand AS slug, max(p_partkey) AS version FROM part GROUP BY 1",
)
def wiki_list(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("version"))
    return bus.latest_version(rows, "slug").select("slug", "version")


@Q.add(
    "R17_hybrid_fallback",
    f"""WITH h AS (SELECT id::VARCHAR AS id, 'ledger' AS origin, 0.75::DOUBLE AS score FROM ({ENTRIES}) WHERE contains(lower(text), 'medium')
      UNION ALL SELECT qualified_name, 'graph', 0.55 FROM ({NODES}) WHERE contains(lower(name), 'medium'))
    SELECT * FROM h ORDER BY score DESC, id LIMIT 20""",
)
def hybrid(spark, d):
    return H.hybrid_fallback(_entries(spark, d), nodes(spark, d), "MEDIUM other words")


@Q.add(
    "M11_build_metrics",
    f"""WITH m AS (SELECT kind AS metric, count(*)::DOUBLE AS value FROM ({NODES}) GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM ({CONTAINMENT}))
    SELECT metric, value, 'count' AS unit FROM m""",
)
def metrics(spark, d):
    by_kind = nodes(spark, d).groupBy(F.col("kind").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    all_edges = containment_edges(spark, d).agg(F.lit("edges").alias("metric"), F.count("*").cast("double").alias("value"))
    return by_kind.union(all_edges).withColumn("unit", F.lit("count"))


@Q.add("S13_S14_L1_append_once", "SELECT o_orderkey AS id, o_custkey AS who FROM orders WHERE o_orderkey % 5 IN (0, 1)")
def append_once(spark, d):
    path = f"{folder(spark)}/append-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"))
    S.append_once(rows.filter("id % 5 = 0"), path, "id", f"{path}-audit")
    S.append_once(rows.filter("id % 5 IN (0, 1)").withColumn("who", F.col("who") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)), path, "id", f"{path}-audit")
    return spark.read.parquet(path)


@Q.add("S15_snapshots", "SELECT 'v1' AS version, count(*) AS rows FROM nation UNION ALL SELECT 'v2', count(*) FROM region")
def snapshots(spark, d):
    path = f"{folder(spark)}/snapshot-{uuid.uuid4().hex}"
    for version, name in (("v1", "nation"), ("v2", "region")):
        S.snapshot({"rows": table(spark, d, name)}, path, version)
    parts = [S.restore(spark, path, v, "rows").agg(F.lit(v).alias("version"), F.count("*").alias("rows")) for v in ("v1", "v2")]
    return parts[0].union(parts[1])


@Q.add(
    "S13_S15_L20_upserts",
    """WITH v1 AS (SELECT o_orderkey AS id, o_custkey AS who, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
    v2 AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS who, o_totalprice AS price FROM orders
      WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0),
    v3 AS (SELECT * FROM v2 WHERE id % 5 <> 0),
    all_v AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3)
    SELECT version, id % 16 AS part, count(*) AS n, sum(who)::BIGINT AS who, round(sum(price), 2) AS price FROM all_v GROUP BY 1, 2""",
)
def upserts(spark, d):
    """A load, a batch of updates and inserts, a batch of deletes; the rows as of each version."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_totalprice").alias("price"))
    held = KeyedStore(spark, f"{folder(spark)}/upserts-{uuid.uuid4().hex}", "id")
    held.upsert(rows.filter("id % 3 <> 0"), "who")
    even = rows.filter("id % 2 = 0")
    held.upsert(even.union(even.withColumn("who", F.col("who") + 1)), "who")
    held.upsert(rows.filter("id % 5 = 0"), "who", F.lit(True))
    parts = [held.read(v).groupBy(F.lit(v).alias("version"), (F.col("id") % 16).alias("part")) for v in (1, 2, 3)]
    sums = [p.agg(F.count("*").alias("n"), F.sum("who").alias("who"), F.round(F.sum(F.col("price").cast("double")), 2).alias("price")) for p in parts]
    return sums[0].union(sums[1]).union(sums[2])


@Q.add("T1_T8_T14_published", "SELECT user_id AS path, max(event_id) AS event_id FROM events GROUP BY 1")
def published(spark, d):
    """Events as a stream, upserted by user: what is left is each user's newest event."""
    path = f"{folder(spark)}/published-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    held = KeyedStore(spark, f"{path}/rows", "path")
    held.upsert_stream(stream.select(F.col("user_id").alias("path"), "event_id"), "event_id", f"{path}/checkpoint").awaitTermination()
    return held.read()


@Q.add(
    "T9_stream_percentiles",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL),
    l AS (SELECT event_type, list_sort(list(value)) AS v FROM s WHERE r <= 256 GROUP BY 1)
    SELECT event_type AS key, len(v) AS n, v[least(floor(0.5 * len(v)), len(v) - 1)::INT + 1] AS p50, v[least(floor(0.95 * len(v)), len(v) - 1)::INT + 1] AS p95,
      v[least(floor(0.99 * len(v)), len(v) - 1)::INT + 1] AS p99 FROM l""",
)
def stream_percentiles(spark, d):
    """Events as a stream with state for each type; each batch's percentiles are upserted."""
    path = f"{folder(spark)}/percentiles-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        held = KeyedStore(spark, f"{path}/rows", "key", 4)
        held.upsert_stream(last_percentiles(stream, "event_type", "ts", "event_id", "value"), "n", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return held.read()


@Q.add(
    "T4_slow_consumers",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN value > 10 THEN 1 ELSE 0 END AS busy, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, busy ORDER BY event_id) AS run FROM e),
    r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, busy, run ORDER BY event_id) AS n FROM g WHERE busy = 1)
    SELECT user_id, min(event_id) AS evicted_at FROM r WHERE n = 3 GROUP BY 1""",
)
def slow_consumers(spark, d):
    sends = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 10).alias("full"))
    return bus.evicted(sends, "user_id", "event_id", "full", 3)


@Q.add(
    "G27_overview",
    f"""{GRAPH}, m AS ({MEMBERS}), c AS (SELECT a.community_id AS c1, b.community_id AS c2, count(*) AS n FROM edges JOIN m a ON a.qualified_name = source
      JOIN m b ON b.qualified_name = target WHERE a.community_id <> b.community_id GROUP BY 1, 2),
    deg AS (SELECT q, count(*) AS n FROM (SELECT source AS q FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)
    SELECT 'coupling' AS part, c1 || '-' || c2 AS name, n FROM c UNION ALL SELECT 'hub', q, n FROM (SELECT * FROM deg JOIN nodes ON qualified_name = q ORDER BY n DESC, q LIMIT 10)
    UNION ALL SELECT 'size', community_id::VARCHAR, count(*) FROM m GROUP BY 2""",
)
def overview(spark, d):
    from lodegraph.operators.graph import god_nodes
    from lodegraph.sources.tables import edges

    e, m = edges(spark, d), membership(spark, d)
    side = lambda x, c: m.select(F.col("qualified_name").alias(x), F.col("community_id").alias(c))
    pairs = e.join(side("source", "c1"), "source").join(side("target", "c2"), "target").filter("c1 <> c2").groupBy("c1", "c2").agg(F.count("*").alias("n"))
    coupling = pairs.select(F.lit("coupling").alias("part"), F.concat_ws("-", F.col("c1").cast("string"), F.col("c2").cast("string")).alias("name"), "n")
    hubs = god_nodes(e, nodes(spark, d), 10).select(F.lit("hub"), "qualified_name", "degree")
    sizes = m.groupBy("community_id").agg(F.count("*").alias("n")).select(F.lit("size"), F.col("community_id").cast("string"), "n")
    return coupling.union(hubs).union(sizes)


@Q.add(
    "G22_layout",
    f"""WITH n AS ({NODES}), r AS (SELECT qualified_name, kind, row_number() OVER (PARTITION BY kind ORDER BY qualified_name) - 1 AS i FROM n),
    k AS (SELECT kind, count(*) AS n, row_number() OVER (ORDER BY kind) - 1 AS g FROM r GROUP BY 1)
    SELECT qualified_name, round(g * 100 + 10 * cos(2 * pi() * i / k.n), 6) + 0.0 AS x, round(10 * sin(2 * pi() * i / k.n), 6) + 0.0 AS y FROM r JOIN k USING (kind)""",
)
def layout(spark, d):
    from lodegraph.operators.graph import circle_layout

    zero = F.lit(0.0)  # a negative zero becomes a plain one
    return circle_layout(nodes(spark, d), "kind").select("qualified_name", (F.round("x", 6) + zero).alias("x"), (F.round("y", 6) + zero).alias("y"))
