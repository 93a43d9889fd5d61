"""Queries of the graph operators over the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.operators.graph import saved
from lodegraph.plans.registry import CONTAINMENT, GRAPH, MEMBERS, ORDER_EDGES, Registry
from lodegraph.sources.tables import containment_edges, edges, membership, nodes, order_edges, table

Q = Registry()


def _seed(spark, d, *names):
    return nodes(spark, d).filter(F.col("qualified_name").isin(*names)).select("qualified_name")


@Q.add(
    "A2_A9_god_nodes",
    f"""{GRAPH}, ends AS (SELECT source AS q, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0
      FROM edges) SELECT q AS qualified_name, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree, name,
      kind FROM ends JOIN nodes ON qualified_name = q GROUP BY q, name, kind ORDER BY degree DESC, q LIMIT 20""",
)
def god_nodes(spark, d):
    return G.god_nodes(edges(spark, d), nodes(spark, d), 20)


@Q.add(
    "G1_blast",
    f"""WITH RECURSIVE edges AS ({CONTAINMENT}), b(node, depth) AS (SELECT 'c:7', 0 UNION
      SELECT target, depth + 1 FROM b JOIN edges ON source = node WHERE depth < 3)
      SELECT node, depth::BIGINT AS depth FROM b WHERE depth > 0""",
)
def blast(spark, d):
    met = G.blast(containment_edges(spark, d), nodes(spark, d), _seed(spark, d, "c:7"), 3, "out")
    return met.select("node", F.col("depth").cast("long").alias("depth"))


@Q.add(
    "G2_G3_dependents",
    f"""WITH RECURSIVE edges AS ({CONTAINMENT}), b(node, depth) AS (SELECT 'r:1', 0 UNION
      SELECT source, depth + 1 FROM b JOIN edges ON target = node WHERE depth < 4)
      SELECT node, min(depth)::BIGINT AS depth FROM b WHERE depth > 0 GROUP BY 1""",
)
def dependents(spark, d):
    seeds = G.seed_nodes(nodes(spark, d), "r:1")
    return G.reach(containment_edges(spark, d), seeds, 4, "in").filter("depth > 0").select("node", F.col("depth").cast("long").alias("depth"))


@Q.add(
    "G4_call_graph",
    f"""WITH edges AS ({ORDER_EDGES}), p AS (SELECT DISTINCT target FROM edges WHERE source = 'c:7')
      SELECT source, target, count(*) AS call_count FROM edges WHERE source = 'c:7'
      AND target IN (FROM p) GROUP BY 1, 2""",
)
def call_graph(spark, d):
    return G.call_graph(order_edges(spark, d), _seed(spark, d, "c:7"), 1)


@Q.add("G5_callers", f"WITH edges AS ({ORDER_EDGES}) SELECT source, count(*) AS n FROM edges WHERE target = 'p:11' GROUP BY 1")
def callers(spark, d):
    return order_edges(spark, d).filter("target = 'p:11'").groupBy("source").agg(F.count("*").alias("n"))


@Q.add(
    "G6_references",
    f"""{GRAPH} SELECT 0::BIGINT AS ord, qualified_name, kind, file_path FROM nodes WHERE qualified_name = 'n:3'
      UNION ALL SELECT 1, source, e.kind, n.file_path FROM edges e JOIN nodes n ON n.qualified_name = source
      WHERE target = 'n:3'""",
)
def references(spark, d):
    found = G.references(edges(spark, d), nodes(spark, d), _seed(spark, d, "n:3"), 100_000)
    return found.withColumn("ord", F.col("ord").cast("long"))


@Q.add(
    "G7_dependency_chain",
    f"""{GRAPH.replace('WITH nodes', 'WITH RECURSIVE nodes')}, f AS (SELECT DISTINCT a.file_path AS s, b.file_path AS t
      FROM edges e JOIN nodes a ON a.qualified_name = e.source JOIN nodes b ON b.qualified_name = e.target
      WHERE e.kind = 'contains'), w(node, depth) AS (SELECT 'supplier/5', 0 UNION
      SELECT t, depth + 1 FROM w JOIN f ON s = node WHERE depth < 10) SELECT node, min(depth)::BIGINT AS depth
      FROM w GROUP BY 1""",
)
def chain(spark, d):
    files = G.file_dependencies(containment_edges(spark, d), nodes(spark, d))
    seed = nodes(spark, d).filter("file_path = 'supplier/5'").select(F.col("file_path").alias("qualified_name"))
    return G.reach(files, seed, 10, "out").select("node", F.col("depth").cast("long").alias("depth"))


@Q.add(
    "G8_cycles",
    """WITH RECURSIVE back AS (SELECT p_partkey AS p, p_partkey // 2 AS c FROM part WHERE p_partkey % 40 = 0),
    step AS (SELECT DISTINCT back.p AS a, l_partkey AS b FROM back JOIN orders ON o_custkey = back.c JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 40 = 0),
    r(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, step.b FROM r JOIN step ON step.a = r.b),
    m AS (SELECT x.a, min('c:' || (x.b // 2)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
    SELECT component, 'p:' || a AS node FROM m UNION ALL SELECT component, 'c:' || (a // 2) FROM m""",
)
def cycles(spark, d):
    # Orders lead from customers to parts; so that there are cycles, cheap parts lead back to the customers of their number.
    back = table(spark, d, "part").filter("p_partkey % 40 = 0").select(
        F.lit("back").alias("kind"), F.concat(F.lit("p:"), "p_partkey").alias("source"), F.concat(F.lit("c:"), (F.col("p_partkey") / 2).cast("long")).alias("target"), F.lit(1.0).alias("weight")
    )
    return G.strong_components(order_edges(spark, d).union(back))


@Q.add(
    "G10_two_hops",
    f"""WITH edges AS ({CONTAINMENT}), a AS (SELECT DISTINCT target AS t FROM edges WHERE source = 's:3'), b AS (SELECT DISTINCT target AS
      t FROM edges WHERE source IN (FROM a)) SELECT 's:3' AS node, 0::BIGINT AS depth
      UNION ALL SELECT t, 1 FROM a UNION ALL SELECT t, 2 FROM b WHERE t NOT IN (FROM a)""",
)
def two_hops(spark, d):
    return G.two_hops(containment_edges(spark, d), _seed(spark, d, "s:3")).select("node", F.col("depth").cast("long").alias("depth"))


@Q.add("G11_G13_communities")
def communities(spark, d):
    return G.communities(edges(spark, d))


#: What a good partition of this graph reaches at least.
LEAST_MODULARITY = 0.1


@Q.add(
    "G11_connected",
    f"""{GRAPH}, ends AS (SELECT source AS q FROM edges WHERE source <> target UNION SELECT target FROM edges WHERE source <> target)
    SELECT count(*) AS nodes, 0::BIGINT AS disconnected, true AS good FROM ends""",
)
def connected(spark, d):
    """All nodes have a community, each community is connected over its own edges, and the modularity is LEAST_MODULARITY or more."""
    e = saved(edges(spark, d).select("source", "target", "weight"))
    found = saved(G.communities(e))
    apart = G.disconnected(e, found).agg(F.count("*").alias("disconnected"))
    good = G.modularity(e, found).select((F.col("modularity") >= LEAST_MODULARITY).alias("good"))
    return found.agg(F.count("*").alias("nodes")).crossJoin(apart).crossJoin(good)  # one row each


@Q.add("G14_betweenness")
def betweenness(spark, d):
    return G.betweenness(edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@Q.add(
    "J11_G16_surprising",
    f"""WITH edges AS ({ORDER_EDGES}), m AS ({MEMBERS}) SELECT kind, source, target, a.community_id AS c1, b.community_id AS c2, round(0.5
      + 0.1 * least(4, abs(a.community_id - b.community_id)), 6) AS confidence FROM (SELECT DISTINCT kind, source, target
      FROM edges) JOIN m a ON a.qualified_name = source JOIN m b ON b.qualified_name = target
      WHERE a.community_id <> b.community_id ORDER BY confidence DESC, source, target, kind LIMIT 50""",
)
def surprising(spark, d):
    return G.surprising(order_edges(spark, d), membership(spark, d), ("orders",), 50).select("kind", "source", "target", "c1", "c2", "confidence")


@Q.add(
    "G20_file_state",
    f"""{GRAPH} SELECT n.qualified_name AS neighbour, n.kind AS kind, count(*) AS n FROM (SELECT CASE
      WHEN source = 'n:3' THEN target ELSE source END AS other FROM edges WHERE source = 'n:3' OR target = 'n:3')
      JOIN nodes n ON n.qualified_name = other GROUP BY 1, 2""",
)
def file_state(spark, d):
    e = edges(spark, d)
    other = e.filter("source = 'n:3'").select(F.col("target").alias("qualified_name")).union(e.filter("target = 'n:3'").select("source"))
    met = other.join(nodes(spark, d), "qualified_name")
    return met.groupBy(F.col("qualified_name").alias("neighbour"), "kind").agg(F.count("*").alias("n"))


@Q.add(
    "G21_graph_diff",
    """WITH a AS (SELECT 'c:' || c_custkey AS q, c_name AS name FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT CASE
      WHEN c_custkey % 13 = 0 THEN 'x:' || c_custkey ELSE 'c:' || c_custkey END AS q, CASE
      WHEN c_custkey % 7 = 0 THEN c_name || '!' ELSE c_name END AS name FROM customer
      WHERE c_custkey % 17 <> 0), f AS (SELECT coalesce(a.q, b.q) AS q, a.name AS an, b.name AS bn, CASE
      WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' WHEN a.name <> b.name THEN 'modified' END AS state
      FROM a FULL JOIN b ON a.q = b.q), r AS (SELECT x.q AS q, y.q AS was FROM f x
      JOIN f y ON x.state = 'added' AND y.state = 'removed' AND x.bn = y.an) SELECT q AS qualified_name, 'renamed' AS state, was
      AS renamed_from FROM r UNION ALL SELECT q, state, NULL FROM f WHERE state IS NOT NULL
      AND q NOT IN (SELECT q FROM r) AND q NOT IN (SELECT was FROM r)""",
)
def diff(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 11 <> 0").select(F.concat(F.lit("c:"), "c_custkey").alias("qualified_name"), F.col("c_name").alias("name"))
    new = c.filter("c_custkey % 17 <> 0").select(
        F.expr("concat(IF(c_custkey % 13 = 0, 'x:', 'c:'), c_custkey)").alias("qualified_name"), F.expr("IF(c_custkey % 7 = 0, concat(c_name, '!'), c_name)").alias("name")
    )
    return G.graph_diff(old, new, columns=("name",))


@Q.add(
    "G23_path_tree",
    """SELECT split_part(p, '/', 1) AS node, NULL AS parent, 1::BIGINT AS depth, count(*) AS leaves, sum(w)::BIGINT AS weight
      FROM (SELECT p_brand || '/' || p_type AS p, p_size AS w FROM part) GROUP BY 1
      UNION ALL SELECT p, split_part(p, '/', 1), 2, count(*), sum(w)::BIGINT FROM (SELECT p_brand || '/' || p_type AS p, p_size AS
      w FROM part) GROUP BY 1, 2""",
)
def tree(spark, d):
    files = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), "p_size")
    return G.path_tree(files, "path", "p_size").withColumn("depth", F.col("depth").cast("long"))


@Q.add(
    "J5_G24_galaxy",
    f"""{GRAPH}, m AS ({MEMBERS}), g AS (SELECT q, count(*) AS degree FROM (SELECT source AS q
      FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) SELECT n.qualified_name, n.kind, coalesce(degree, 0) AS degree,
      coalesce(community_id, -1) AS community_id FROM nodes n LEFT JOIN g ON q = n.qualified_name
      LEFT JOIN m ON m.qualified_name = n.qualified_name""",
)
def galaxy(spark, d):
    met = nodes(spark, d).join(G.degrees(edges(spark, d)).select("qualified_name", "degree"), "qualified_name", "left")
    met = met.join(membership(spark, d), "qualified_name", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).cast("long").alias(c)
    return met.select("qualified_name", "kind", zero("degree", 0), zero("community_id", -1))


@Q.add(
    "G25_tiers",
    f"""WITH nodes AS ({GRAPH.split('WITH nodes AS (')[1].split('), edges AS')[0]}) SELECT CASE
      WHEN kind IN ('part') THEN 'data' WHEN kind = 'supplier' THEN 'api' ELSE 'other' END AS tier, count(*) AS n
      FROM nodes GROUP BY 1""",
)
def tiers(spark, d):
    path = F.expr("concat(CASE kind WHEN 'part' THEN 'store' WHEN 'supplier' THEN 'server' ELSE kind END, '/', name)")
    return nodes(spark, d).withColumn("path", path).groupBy(G.tier("path").alias("tier")).agg(F.count("*").alias("n"))


@Q.add(
    "G26_blast_risk",
    f"""WITH edges AS ({ORDER_EDGES}), c AS (SELECT target, count(DISTINCT source) AS direct, count(*) - count(DISTINCT source) AS
      transitive, count(*) FILTER (weight > 45) AS tests FROM edges GROUP BY 1), l AS (SELECT *, CASE
      WHEN direct + transitive > 100 THEN 3 WHEN direct > 15 OR transitive > 20 THEN 2
      WHEN direct > 5 THEN 1 ELSE 0 END AS v FROM c) SELECT target, CASE CASE WHEN tests = 0
      AND direct + transitive > 0 THEN least(v + 1, 3) ELSE v END WHEN 0 THEN 'low'
      WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS risk FROM l""",
)
def blast_risk(spark, d):
    c = order_edges(spark, d).groupBy("target").agg(
        F.countDistinct("source").alias("direct"), (F.count("*") - F.countDistinct("source")).alias("transitive"), F.count_if(F.col("weight") > 45).alias("tests")
    )
    return c.select("target", G.blast_risk(F.col("direct"), F.col("transitive"), F.col("tests"), F.lit(0)).alias("risk"))


RINGS = """SELECT p_partkey AS a, CASE WHEN p_partkey % 20 = 19 THEN p_partkey - 19 ELSE p_partkey + 1 END AS b FROM part
  UNION ALL SELECT p_partkey, p_partkey - 14 FROM part WHERE p_partkey % 40 = 14"""


@Q.add(
    "G9_shortest_cycles",
    f"""WITH RECURSIVE e AS (SELECT 'p:' || a AS s, 'p:' || b AS t FROM ({RINGS})),
    r(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b),
    starts AS (SELECT a AS start FROM r WHERE a = b ORDER BY a LIMIT 10),
    w(start, node, way, back) AS (SELECT start, start, [start], false FROM starts
      UNION ALL SELECT start, t, CASE WHEN t = start THEN way ELSE list_append(way, t) END, t = start FROM w JOIN e ON s = node WHERE NOT back AND (t = start OR NOT list_contains(way, t))),
    found AS (SELECT start, way, row_number() OVER (PARTITION BY start ORDER BY len(way), way) AS k FROM w WHERE back),
    once AS (SELECT start, way, row_number() OVER (PARTITION BY list_sort(way) ORDER BY start) AS k FROM found WHERE k = 1)
    SELECT start, len(way) AS length, way AS nodes FROM once WHERE k = 1 ORDER BY 2, 1 LIMIT 8""",
)
def shortest_cycles(spark, d):
    """Rings of twenty parts each, every other one with a short cut; the last ring of the table may be open."""
    part = table(spark, d, "part")
    ring = part.selectExpr("p_partkey AS a", "IF(p_partkey % 20 = 19, p_partkey - 19, p_partkey + 1) AS b")
    ring = ring.union(part.filter("p_partkey % 40 = 14").selectExpr("p_partkey", "p_partkey - 14"))
    return G.shortest_cycles(ring.selectExpr("concat('p:', a) AS source", "concat('p:', b) AS target"), most=8)


@Q.add("G12_oversized_split", "SELECT p_brand || '/' || (p_partkey % 2) AS member, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def oversized(spark, d):
    """One community of all parts, whose edges go round within each half of each brand: every half comes out as one."""
    part = table(spark, d, "part").select(F.concat_ws("/", "p_brand", (F.col("p_partkey") % 2).cast("string")).alias("half"), F.concat(F.lit("p:"), "p_partkey").alias("q"))
    hub = part.groupBy("half").agg(F.min("q").alias("hub"))
    star = part.join(hub, "half").filter("q <> hub").select(F.col("hub").alias("source"), F.col("q").alias("target"), F.lit(1.0).alias("weight"))
    whole = part.select(F.col("q").alias("qualified_name"), F.lit(0).cast("long").alias("community_id"))
    found = G.split_oversized(star, whole).join(part.withColumnRenamed("q", "qualified_name"), "qualified_name")
    return found.groupBy("community_id").agg(F.min("half").alias("member"), F.count("*").alias("n"), F.countDistinct("half").alias("k")).filter("k = 1 AND n > 1").select("member", "n")


@Q.add(
    "G11_cohesion",
    f"""WITH e AS ({CONTAINMENT}), m AS ({MEMBERS}), j AS (SELECT a.community_id AS a, b.community_id AS b, weight FROM e JOIN m a ON a.qualified_name = source JOIN (
      SELECT qualified_name, community_id FROM m UNION ALL SELECT 'n:' || n_nationkey, (n_nationkey % 5)::BIGINT FROM nation) b ON b.qualified_name = target)
    SELECT community_id, sum(weight) FILTER (a = b) AS inside, sum(weight) AS incident, sum(weight) FILTER (a = b) / sum(weight) AS cohesion
    FROM (SELECT a AS community_id, a, b, weight FROM j UNION ALL SELECT b, a, b, weight FROM j WHERE a <> b) GROUP BY 1""",
)
def cohesion(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("qualified_name"), (F.col("n_nationkey") % 5).cast("long").alias("community_id"))
    return G.cohesion(containment_edges(spark, d), membership(spark, d).union(n))


@Q.add(
    "J2_blast_unknown",
    f"WITH e AS ({CONTAINMENT}) SELECT 1::BIGINT AS depth, target AS node, CASE WHEN target IN ('n:0', 'n:1') THEN '?' ELSE 'nation' END AS kind FROM e WHERE source IN ('c:1', 'c:2', 'c:3', 'c:4', 'c:5') GROUP BY target",
)
def blast_unknown(spark, d):
    known = nodes(spark, d).filter("qualified_name NOT IN ('n:0', 'n:1')")
    seeds = _seed(spark, d, "c:1", "c:2", "c:3", "c:4", "c:5")
    return G.blast(containment_edges(spark, d), known, seeds, 1).select(F.col("depth").cast("long").alias("depth"), "node", "kind")
