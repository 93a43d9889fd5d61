"""Queries of the relational operators: projections, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.operators import relational as R
from lodegraph.plans.registry import CONTAINMENT, GRAPH, MEMBERS, NODES, ORDER_EDGES, Registry
from lodegraph.sources.tables import containment_edges, edges, key, membership, nodes, order_edges, order_lines, spread, table, tasks_for

Q = Registry()


@Q.add(
    "S1_P1_P7_scan",
    """SELECT event_id, user_id AS uid, value AS amount FROM events WHERE ts >= TIMESTAMP '2024-01-01'
      AND event_type IN ('click', 'purchase', 'view')""",
)
def scan(spark, d):
    rows = table(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-01").cast("timestamp")) & F.col("event_type").isin("click", "purchase", "view"))
    return rows.select("event_id", F.col("user_id").alias("uid"), F.col("value").alias("amount"))


@Q.add("P3_substring", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'token =') OR contains(lower(source), 'src1')")
def substring(spark, d):
    return table(spark, d, "documents").filter(R.contains_any("token =", "text") | R.contains_any("src1", "source")).select("doc_id", "lang")


@Q.add(
    "P4_P13_name_search",
    f"""WITH nodes AS ({NODES}) SELECT qualified_name, name FROM nodes WHERE contains(lower(name), 'supplier#00000000') OR
      contains(lower(qualified_name), 'supplier#00000000') ORDER BY length(qualified_name), qualified_name LIMIT 20""",
)
def name_search(spark, d):
    return R.name_search(nodes(spark, d), "Supplier#00000000", 20).select("qualified_name", "name")


@Q.add(
    "P5_suffix",
    f"""WITH nodes AS ({NODES}) SELECT qualified_name, kind FROM nodes WHERE qualified_name = '7' OR qualified_name LIKE '%:7'""",
)
def suffix(spark, d):
    return R.suffix_match(nodes(spark, d), "7").select("qualified_name", "kind")


@Q.add(
    "P2_P6_P16_open_customers",
    """SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey
      FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def open_customers(spark, d):
    building = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").join(building, "o_custkey", "left_semi").select("o_custkey").distinct()


@Q.add(
    "P8_coalesce",
    f"""{GRAPH} SELECT e.source, e.target, coalesce(n.name, e.source) AS label FROM edges e
      LEFT JOIN nodes n ON n.qualified_name = e.target AND n.kind = 'part' WHERE e.kind = 'contains'""",
)
def coalesced(spark, d):
    parts = nodes(spark, d).filter("kind = 'part'").select(F.col("qualified_name").alias("target"), "name")
    e = containment_edges(spark, d).join(parts, "target", "left")
    return e.select("source", "target", F.coalesce("name", "source").alias("label"))


@Q.add(
    "P9_case_rank",
    """SELECT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3
      WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END::BIGINT AS rank, count(*) AS n FROM orders
      GROUP BY 1, 2""",
)
def case_rank(spark, d):
    c = F.substring("o_orderpriority", 1, 1)
    rank = F.when(c == "1", 4).when(c == "2", 3).when(c == "3", 2).when(c == "4", 1).otherwise(0).cast("long")
    return table(spark, d, "orders").groupBy("o_orderpriority", rank.alias("rank")).agg(F.count("*").alias("n"))


@Q.add("P12_glob", f"WITH nodes AS ({NODES}) SELECT qualified_name FROM nodes WHERE regexp_full_match(file_path, 'part/[^/][^/]7')")
def glob(spark, d):
    return nodes(spark, d).filter(F.col("file_path").rlike(R.glob_pattern("**/??7")) & F.col("file_path").startswith("part/")).select("qualified_name")


@Q.add(
    "P11_ignored_paths",
    """SELECT page_id, regexp_matches(url, '(^|/)(node_modules|target|dist|build|\\.git|vendor|__pycache__)(/|$)') AS ignored
      FROM pages""",
)
def ignored(spark, d):
    return table(spark, d, "pages").select("page_id", R.is_ignored_path("url").alias("ignored"))


@Q.add(
    "P14_P15_top_k",
    """SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey
      LIMIT 25""",
)
def top_k(spark, d):
    at = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, d, "customer").orderBy(at.desc_nulls_last(), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@Q.add(
    "P18_J10_first_n",
    f"""{GRAPH}, v AS (SELECT qualified_name FROM nodes ORDER BY qualified_name LIMIT 1520)
      SELECT kind, source, target, weight FROM edges WHERE source IN (FROM v) AND target IN (FROM v)""",
)
def first_n(spark, d):
    return R.first_n_subgraph(nodes(spark, d), edges(spark, d), "qualified_name", 1520)


@Q.add(
    "J1_A4_kind_flow",
    f"""{GRAPH} SELECT s.kind AS source_kind, t.kind AS target_kind, e.kind AS edge_kind, count(*) AS n
      FROM edges e JOIN nodes s ON s.qualified_name = e.source JOIN nodes t ON t.qualified_name = e.target
      GROUP BY 1, 2, 3""",
)
def kind_flow(spark, d):
    return R.kind_flow(edges(spark, d), nodes(spark, d))


@Q.add(
    "J7_A13_rollup",
    """SELECT o_orderkey, count(l_orderkey) AS files, coalesce(sum(l_quantity), 0)::DOUBLE AS additions, round(coalesce(sum(l_tax), 0),
      6)::DOUBLE AS deletions FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500)
      LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def rollup(spark, d):
    last = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    met = last.join(lines, last.o_orderkey == lines.l_orderkey, "left")
    zero = F.lit(0.0)
    return met.groupBy("o_orderkey").agg(
        F.count("l_orderkey").alias("files"),
        F.coalesce(F.sum("l_quantity"), zero).alias("additions"),
        F.round(F.coalesce(F.sum("l_tax"), zero), 6).alias("deletions"),
    )


@Q.add(
    "J8_A15_churn",
    """SELECT l_partkey, sum(l_quantity)::DOUBLE AS churn FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
      GROUP BY 1""",
)
def churn(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    late = orders.join(F.broadcast(last), F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 90 DAYS"))  # one row
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(late, lines.l_orderkey == late.o_orderkey).groupBy("l_partkey").agg(F.sum("l_quantity").alias("churn"))


@Q.add("S2_J9_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def orphans(spark, d):
    return R.orphans(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").filter("o_totalprice > 400000"), "o_custkey")


@Q.add(
    "J3_A3_edges_of_file",
    """SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_custkey = 7 OR l_partkey = 7""",
)
def edges_of_file(spark, d):
    e = order_lines(spark, d, "l_orderkey", "l_linenumber", "o_custkey", "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("c:"), "o_custkey").alias("source"),
        F.concat(F.lit("p:"), "l_partkey").alias("target"),
    )
    own = nodes(spark, d).filter("file_path IN ('customer/7', 'part/7')").withColumn("file_path", F.lit("seven"))
    return R.files_touching(e, own, "seven")


@Q.add(
    "J4_neighbours",
    f"""WITH edges AS ({ORDER_EDGES}) SELECT o AS self, count(DISTINCT other) AS neighbours
      FROM (SELECT source AS o, target AS other FROM edges UNION ALL SELECT target, source
      FROM edges) GROUP BY 1""",
)
def neighbours(spark, d):
    # Pairs are made different as numbers, once for both directions; names come after.
    lines = order_lines(spark, d, "o_custkey", "l_partkey")
    pairs = spread(lines, tasks_for(table(spark, d, "lineitem")), "o_custkey", "l_partkey").distinct()
    side = lambda kind, own, other: pairs.groupBy(own).agg(F.count(other).alias("n")).select(key(kind, own).alias("self"), "n")
    both = side("customer", "o_custkey", "l_partkey").union(side("part", "l_partkey", "o_custkey"))
    return both.groupBy("self").agg(F.sum("n").alias("neighbours"))


@Q.add(
    "J6_W1_W6_latest",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def latest(spark, d):
    return R.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@Q.add(
    "J16_full_outer",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed'
      WHEN a.v = b.v THEN 'same' ELSE 'modified' END AS state FROM (SELECT c_custkey AS k, c_nationkey AS v
      FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE
      WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k""",
)
def full_outer(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("va"), F.lit(1).alias("a"))
    b = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.expr("IF(c_custkey % 7 = 0, 99, c_nationkey)").alias("vb"), F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("va") == F.col("vb"), "same").otherwise("modified")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@Q.add(
    "A1_graph_stats",
    f"""{GRAPH} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL
      SELECT 'edge', kind, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'file', 'all', count(DISTINCT file_path)
      FROM nodes""",
)
def graph_stats(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    per = lambda what, df: df.groupBy(F.lit(what).alias("what"), "kind").agg(F.count("*").alias("n"))
    return per("node", n).union(per("edge", e)).union(n.agg(F.lit("file").alias("what"), F.lit("all").alias("kind"), F.countDistinct("file_path").alias("n")))


@Q.add(
    "A5_domain_flow",
    f"""{GRAPH} SELECT split_part(s.file_path, '/', 1) AS source_domain, split_part(t.file_path, '/', 1) AS target_domain, count(*) AS n
      FROM edges e JOIN nodes s ON s.qualified_name = e.source JOIN nodes t ON t.qualified_name = e.target
      WHERE split_part(s.file_path, '/', 1) <> split_part(t.file_path, '/', 1) GROUP BY 1, 2""",
)
def domain_flow(spark, d):
    return R.domain_flow(edges(spark, d), nodes(spark, d))


@Q.add(
    "A6_community_matrix",
    f"""{GRAPH}, m AS ({MEMBERS}), top AS (SELECT community_id FROM m GROUP BY 1 ORDER BY count(*) DESC, community_id LIMIT 6)
      SELECT a.community_id AS source_community, b.community_id AS target_community, count(*) AS n
      FROM edges e JOIN m a ON a.qualified_name = e.source JOIN m b ON b.qualified_name = e.target
      WHERE a.community_id IN (FROM top) AND b.community_id IN (FROM top) GROUP BY 1, 2""",
)
def matrix(spark, d):
    return R.community_matrix(edges(spark, d), membership(spark, d), 6)


@Q.add(
    "A7_coupling",
    f"""{GRAPH}, m AS ({MEMBERS}), z AS (SELECT community_id AS c, count(*) AS m FROM m GROUP BY 1), p AS (SELECT least(a.community_id,
      b.community_id) AS a, greatest(a.community_id, b.community_id) AS b, count(*) AS n
      FROM edges e JOIN m a ON a.qualified_name = e.source JOIN m b ON b.qualified_name = e.target
      GROUP BY 1, 2) SELECT a, b, n, round(n / greatest(1, CASE WHEN a = b THEN x.m * (x.m - 1) ELSE x.m * y.m END), 9) AS density
      FROM p JOIN z x ON x.c = a JOIN z y ON y.c = b""",
)
def coupling(spark, d):
    return R.coupling(edges(spark, d), membership(spark, d)).withColumn("density", F.round("density", 9))


@Q.add(
    "A8_risk",
    """WITH s AS (SELECT l_partkey, p_size % 5 AS community_id, count(*) AS callers, avg(l_discount) AS crit, sum(CASE
      WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hits FROM lineitem JOIN part ON p_partkey = l_partkey
      GROUP BY 1, 2) SELECT community_id::BIGINT AS community_id, round(sum(callers) * (0.1 + avg(crit)) * (1 + 0.5 * sum(hits)),
      2) AS risk FROM s GROUP BY 1""",
)
def risk(spark, d):
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    s = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy((F.col("p_size") % 5).cast("long").alias("community_id"), "l_partkey")
    s = s.agg(F.count("*").alias("callers"), F.avg("l_discount").alias("criticality"), F.count_if(F.col("l_returnflag") == "R").alias("security_hits"))
    return R.risk_index(s.withColumn("qualified_name", F.concat(F.lit("p:"), "l_partkey"))).select("community_id", F.round("risk", 2).alias("risk"))


@Q.add(
    "A10_status_pivot",
    """SELECT o_orderpriority AS scanner, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS closed,
      count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""",
)
def status_pivot(spark, d):
    met = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scanner")).pivot("o_orderstatus", ["O", "F", "P"]).count().fillna(0)
    return met.select("scanner", F.col("O").alias("open"), F.col("F").alias("closed"), F.col("P").alias("partial"))


@Q.add(
    "A11_heatmap",
    """SELECT p_partkey, count(l_partkey) AS lines, count(*) FILTER (l_returnflag = 'R') AS critical, count(*) FILTER (l_returnflag =
      'A') AS warning, round(coalesce(sum(l_extendedprice), 0), 2)::DOUBLE AS amount
      FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""",
)
def heatmap(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("critical"),
        F.count_if(F.col("l_returnflag") == "A").alias("warning"), F.sum("l_extendedprice").alias("amount"),
    )
    met = table(spark, d, "part").select("p_partkey").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "critical", "warning")]
    return met.select("p_partkey", *zero, F.round(F.coalesce("amount", F.lit(0.0)), 2).alias("amount"))


@Q.add("A14_lines_per_order", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def lines_per_order(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@Q.add(
    "A16_grouped_recall",
    """SELECT source, count(*) AS hits FROM documents WHERE contains(lower(text), 'the')
      GROUP BY 1 ORDER BY hits DESC, source LIMIT 10""",
)
def grouped_recall(spark, d):
    hits = table(spark, d, "documents").filter(R.contains_any("the", "text")).groupBy("source").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "source").limit(10)


@Q.add("A17_M9_counters", "SELECT user_id, count(*) AS encounters, max(value) AS score FROM events GROUP BY 1")
def counters(spark, d):
    return R.upsert_counters(table(spark, d, "events"), "user_id", "value")


@Q.add(
    "A18_decay",
    """SELECT user_id, round(CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN greatest(0.01, 0.95 * max(value))
      ELSE max(value) END, 9) AS score FROM events GROUP BY 1""",
)
def decayed(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("score"), F.max("ts").alias("seen"))
    last = F.broadcast(table(spark, d, "events").agg(F.max("ts").alias("now")))  # one row
    met = e.join(last, F.col("seen") <= F.col("now"))
    return R.decay(met, F.col("seen") < F.col("now") - F.expr("INTERVAL 1 DAY")).select("user_id", F.round("score", 9).alias("score"))


PERCENTILES = """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
l AS (SELECT event_type, list_sort(list(value)) AS v FROM s WHERE r <= 256 GROUP BY 1)
SELECT event_type, v[least(floor(0.5 * len(v)), len(v) - 1)::INT + 1] AS p50, v[least(floor(0.95 * len(v)), len(v) - 1)::INT + 1] AS p95,
       v[least(floor(0.99 * len(v)), len(v) - 1)::INT + 1] AS p99 FROM l
"""


@Q.add("A19_W5_T9_percentiles", PERCENTILES)
def percentiles(spark, d):
    last = R.last_samples(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("event_type").agg(*R.nearest_rank("value", 0.5, 0.95, 0.99))


@Q.add("A20_A25_mean_of_percentiles", f"SELECT floor(avg(p50))::BIGINT AS p50, floor(avg(p95))::BIGINT AS p95 FROM ({PERCENTILES})")
def mean_of_percentiles(spark, d):
    return percentiles(spark, d).agg(F.floor(F.avg("p50")).alias("p50"), F.floor(F.avg("p95")).alias("p95"))


@Q.add(
    "A21_A23_thresholds",
    f"""WITH edges AS ({ORDER_EDGES}), g AS (SELECT target, count(*) AS n FROM edges GROUP BY 1), l AS (SELECT list_sort(list(n)) AS v
      FROM g) SELECT greatest(1, v[least(floor(0.95 * len(v)), len(v) - 1)::INT + 1]) AS p95, v[len(v) // 2 + 1] AS upper_median
      FROM l""",
)
def thresholds(spark, d):
    # percentile_disc by counting: each value's rank range, so no array of all values is built.
    n = order_edges(spark, d).groupBy("target").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    w = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)  # as many rows as there are different degrees
    run = n.withColumn("upto", F.sum("m").over(w)).withColumn("total", F.sum("m").over(W.partitionBy(F.lit(0))))
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
    return run.agg(
        F.greatest(F.lit(1), F.min(F.when(F.col("upto") > at(0.95), F.col("n")))).cast("long").alias("p95"),
        F.min(F.when(F.col("upto") > at(0.5), F.col("n"))).alias("upper_median"),
    )


@Q.add(
    "A22_z_scores",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round((n - avg(n) OVER ()) / stddev_pop(n)
      OVER (), 6) AS z FROM g""",
)
def z_scores(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.z_scores(g, "n").select("o_custkey", F.round("z", 6).alias("z"))


@Q.add(
    "A24_majority",
    """WITH c AS (SELECT l_suppkey, CASE WHEN l_quantity > 10 THEN 'large' ELSE 'small' END AS v, count(*) AS n
      FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS total, row_number() OVER
      (PARTITION BY l_suppkey ORDER BY n DESC, v) AS r FROM c) SELECT l_suppkey, v AS value, n, total, round(n / total, 9) AS
      confidence FROM t WHERE r = 1 AND total >= 3 AND n / total >= 0.8""",
)
def majority(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.expr("IF(l_quantity > 10, 'large', 'small')").alias("v"))
    return R.majority(rows, ["l_suppkey"], "v").withColumn("confidence", F.round("confidence", 9))


@Q.add(
    "A26_project_rollup",
    f"""WITH edges AS ({ORDER_EDGES}) SELECT n_name AS project, count(DISTINCT c_custkey) AS nodes, count(source) AS edges
      FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN edges ON source = 'c:' || c_custkey
      GROUP BY 1""",
)
def project_rollup(spark, d):
    per = order_edges(spark, d).groupBy("source").agg(F.count("*").alias("e"))
    c = table(spark, d, "customer").withColumn("source", F.concat(F.lit("c:"), "c_custkey")).join(per, "source", "left")
    met = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


@Q.add(
    "A27_table_health",
    """SELECT 'customer' AS name, true AS present, count(*) AS rows FROM customer UNION ALL
      SELECT 'orders', true, count(*) FROM orders UNION ALL SELECT 'events', true, count(*)
      FROM events""",
)
def table_health(spark, d):
    return R.table_health({n: table(spark, d, n) for n in ("customer", "orders", "events")})


@Q.add(
    "U1_U2_union",
    """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey
      FROM customer WHERE c_acctbal > 5000""",
)
def union_distinct(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey")).distinct()


@Q.add(
    "U3_union_all",
    f"""WITH edges AS ({CONTAINMENT}) SELECT e AS qualified_name, count(*) AS ends FROM (SELECT source AS e
      FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1""",
)
def union_all(spark, d):
    e = containment_edges(spark, d)
    return e.select(F.col("source").alias("qualified_name")).union(e.select("target")).groupBy("qualified_name").agg(F.count("*").alias("ends"))


@Q.add(
    "U4_U5_differences",
    f"""WITH a AS (SELECT DISTINCT source, target FROM ({ORDER_EDGES}) WHERE weight > 5), b AS (SELECT DISTINCT source, target
      FROM ({ORDER_EDGES}) WHERE weight <= 40) SELECT 'added' AS side, count(*) AS n
      FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'removed', count(*) FROM (FROM a EXCEPT
      FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b)""",
)
def differences(spark, d):
    e = order_edges(spark, d)
    # One aggregate instead of three set operations: each pair once, with the sides it is on.
    sides = e.groupBy("source", "target").agg(F.bool_or(F.col("weight") > 5).alias("a"), F.bool_or(F.col("weight") <= 40).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "removed").otherwise("added")
    counted = sides.groupBy(side.alias("side")).agg(F.count("*").alias("n"))
    every = sides.sparkSession.sql("SELECT explode(array('added', 'removed', 'both')) AS side")
    return every.join(counted, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@Q.add(
    "W2_rank",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::BIGINT AS rank
      FROM events""",
)
def ranks(spark, d):
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")
    return table(spark, d, "events").select("event_id", "event_type", rank.alias("rank"))


@Q.add(
    "W4_three_close",
    """SELECT user_id, count(*) AS bursts FROM (SELECT user_id, ts, lead(ts, 2) OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS third FROM events) WHERE third - ts <= INTERVAL 6 HOUR
      GROUP BY 1""",
)
def three_close(spark, d):
    third = F.lead("ts", 2).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    near = table(spark, d, "events").withColumn("third", third).filter("third <= ts + INTERVAL 6 HOURS")
    return near.groupBy("user_id").agg(F.count("*").alias("bursts"))
