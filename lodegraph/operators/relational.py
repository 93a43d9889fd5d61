"""Filters, rankings, aggregates and joins over the graph and its side tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "error", "medium", "warning", "low", "info")


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive substring search; % and _ are ordinary characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return out


def name_search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose name or qualified name holds text, shortest qualified name first."""
    return nodes.filter(contains_any(text, "name", "qualified_name")).orderBy(F.length("qualified_name"), "qualified_name").limit(limit)


def suffix_match(nodes: DataFrame, name: str, separators: tuple[str, ...] = ("::", ".", ":")) -> DataFrame:
    """Nodes named so exactly, or whose qualified name ends with a separator and the name."""
    hit = F.col("qualified_name") == name
    for s in separators:
        hit = hit | F.col("qualified_name").endswith(s + name)
    return nodes.filter(hit)


def severity_rank(column: str, strict: bool = False) -> Column:
    """Rank of a severity label.  strict: only critical, high, medium and low count, 4 to 1; else the union of both vocabularies."""
    ranks = {"critical": 4, "high": 3, "medium": 2, "low": 1} if strict else {"critical": 4, "high": 3, "error": 3, "medium": 2, "warning": 2, "low": 1, "info": 0}
    out = F.lit(0)
    for label, r in ranks.items():
        out = F.when(F.lower(F.col(column)) == label, F.lit(r)).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """A glob with *, ?, ** and **/ as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + {"*": "[^/]*", "?": "[^/]"}[glob[i]], i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


#: Path segments of generated or foreign files (fixed values).
IGNORED_SEGMENTS = ("node_modules", "target", "dist", "build", ".git", "vendor", "__pycache__")


def is_ignored_path(column: str) -> Column:
    names = "|".join(map(re.escape, IGNORED_SEGMENTS))
    return F.regexp_replace(column, r"\\", "/").rlike(rf"(^|/)({names})(/|$)")


def first_n_subgraph(nodes: DataFrame, edges: DataFrame, order: str, n: int) -> DataFrame:
    """Edges with both ends among the first n nodes."""
    seen = nodes.orderBy(order).limit(n).select("qualified_name")
    ends = lambda c: seen.select(F.col("qualified_name").alias(c))
    return edges.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi").select(*edges.columns)


def kind_flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many edges of each kind lead from each kind of node to each."""
    s = nodes.select(F.col("qualified_name").alias("source"), F.col("kind").alias("source_kind"))
    t = nodes.select(F.col("qualified_name").alias("target"), F.col("kind").alias("target_kind"))
    met = edges.join(s, "source").join(t, "target")
    return met.groupBy("source_kind", "target_kind", F.col("kind").alias("edge_kind")).agg(F.count("*").alias("n"))


def domain_flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different first path segments."""
    domain = F.substring_index("file_path", "/", 1)
    s = nodes.select(F.col("qualified_name").alias("source"), domain.alias("source_domain"))
    t = nodes.select(F.col("qualified_name").alias("target"), domain.alias("target_domain"))
    met = edges.join(s, "source").join(t, "target").filter("source_domain <> target_domain")
    return met.groupBy("source_domain", "target_domain").agg(F.count("*").alias("n"))


def community_pairs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n): edges between communities, unordered."""
    s = members.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("c1"))
    t = members.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("c2"))
    met = edges.join(s, "source").join(t, "target")
    return met.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.count("*").alias("n"))


def coupling(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n, density): pair counts over n(n-1) within a community and na*nb across, 1 at least."""
    sizes = members.groupBy("community_id").agg(F.count("*").alias("m"))
    sa = sizes.select(F.col("community_id").alias("a"), F.col("m").alias("ma"))
    sb = sizes.select(F.col("community_id").alias("b"), F.col("m").alias("mb"))
    room = F.when(F.col("a") == F.col("b"), F.col("ma") * (F.col("ma") - 1)).otherwise(F.col("ma") * F.col("mb"))
    met = community_pairs(edges, members).join(sa, "a").join(sb, "b")
    return met.select("a", "b", "n", (F.col("n") / F.greatest(room, F.lit(1))).alias("density"))


def community_matrix(edges: DataFrame, members: DataFrame, top: int = 24) -> DataFrame:
    """(source_community, target_community, n) between the `top` largest communities; pairs without an edge are left out."""
    sizes = members.groupBy("community_id").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "community_id").limit(top)
    kept = members.join(sizes.select("community_id"), "community_id", "left_semi")
    s = kept.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("source_community"))
    t = kept.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("target_community"))
    return edges.join(s, "source").join(t, "target").groupBy("source_community", "target_community").agg(F.count("*").alias("n"))


def risk_index(symbols: DataFrame, top: int = 5) -> DataFrame:
    """Per community: callers * (0.1 + mean criticality) * (1 + 0.5 * security hits), with the symbols most called.

    symbols: (community_id, qualified_name, callers, criticality, security_hits)
    """
    rank = F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("callers"), "qualified_name"))
    best = symbols.withColumn("rank", rank)
    risk = F.sum("callers") * (0.1 + F.avg("criticality")) * (1 + 0.5 * F.sum("security_hits"))
    tops = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "qualified_name"))))
    return best.groupBy("community_id").agg(risk.alias("risk"), F.transform(tops, lambda x: x["qualified_name"]).alias("top_symbols"))


def files_touching(edges: DataFrame, nodes: DataFrame, file_path: str) -> DataFrame:
    """How many different edges start or end in a file: two joins, as an OR over both ends can't be pushed down."""
    own = nodes.filter(F.col("file_path") == file_path).select("qualified_name")
    out = edges.join(own.withColumnRenamed("qualified_name", "source"), "source", "left_semi").select("id")
    into = edges.join(own.withColumnRenamed("qualified_name", "target"), "target", "left_semi").select("id")
    return out.union(into).distinct().agg(F.count("*").alias("n"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def nearest_rank(column: str, *shares: float) -> list[Column]:
    """Percentiles by floor(q * n), not interpolated; the group's values must fit one row."""
    values = F.sort_array(F.collect_list(column))
    at = lambda q: F.least(F.floor(F.lit(q) * F.size(values)).cast("int"), F.size(values) - 1) + 1
    return [F.when(F.size(values) > 0, F.element_at(values, at(q))).alias(f"p{round(q * 100)}") for q in shares]


def last_samples(rows: DataFrame, keys: list[str], order: list, n: int = 256) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def z_scores(rows: DataFrame, column: str, out: str = "z") -> DataFrame:
    """Population z-scores; 0 where all values are equal."""
    stats = rows.agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd"))
    # One row: a broadcast of fixed size.
    met = rows.crossJoin(F.broadcast(stats))
    z = F.when(F.col("__sd") < 1e-9, 0.0).otherwise((F.col(column) - F.col("__mean")) / F.col("__sd"))
    return met.withColumn(out, z).drop("__mean", "__sd")


def majority(rows: DataFrame, keys: list[str], value: str, share: float = 0.8, support: int = 3) -> DataFrame:
    """The commonest value of each key, where it has the share and the group the support; ties by value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), value)))
    kept = ranked.filter((F.col("rank") == 1) & (F.col("total") >= support) & (F.col("n") / F.col("total") >= share))
    return kept.select(*keys, F.col(value).alias("value"), "n", "total", (F.col("n") / F.col("total")).alias("confidence"))


def orphans(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    known = targets.select(F.col(key).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def first_existing(rows: DataFrame, row_key: str, candidates: str, known: DataFrame, known_key: str) -> DataFrame:
    """(row_key, found): of each row's array of candidates, the first that exists in known."""
    each = rows.select(row_key, F.posexplode(candidates).alias("rank", "candidate"))
    met = each.join(known.select(F.col(known_key).alias("candidate")).distinct(), "candidate", "left_semi")
    return met.groupBy(row_key).agg(F.min_by("candidate", "rank").alias("found"))


def resolve_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (id, file_path, callee) against index (name, qualified_name, file_path, ord): the first of the same file, else the first.

    The bare name is what follows the last :: and then the last dot.  The index is cut down to the first of each name and the first
    of each name and file before calls meet it, so a call meets two rows at most.
    """
    bare = F.substring_index(F.substring_index("callee", "::", -1), ".", -1)
    first = F.min(F.struct("ord", "qualified_name"))
    by_file = index.groupBy("name", "file_path").agg(first.alias("near"))
    by_name = index.groupBy("name").agg(first.alias("any"))
    met = calls.withColumn("name", bare).join(by_file, ["name", "file_path"], "left").join(by_name, "name")
    return met.select("id", "callee", F.coalesce("near.qualified_name", "any.qualified_name").alias("target"))


def decay(scores: DataFrame, stale: Column, factor: float = 0.95, floor: float = 0.01) -> DataFrame:
    return scores.withColumn("score", F.when(stale, F.greatest(F.lit(floor), F.col("score") * factor)).otherwise(F.col("score")))


def upsert_counters(log: DataFrame, key: str, score: str | None = None) -> DataFrame:
    """What repeated upserts leave: the number of encounters, and the largest score."""
    return log.groupBy(key).agg(F.count("*").alias("encounters"), *([F.max(score).alias("score")] if score else []))


def table_health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, present, rows) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        if df is None:
            continue
        one = df.agg(F.lit(name).alias("name"), F.lit(True).alias("present"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out
