"""Reads of a ledger: why, history, constraints, steps, proposals, snapshots, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.operators.graph import saved
from lodegraph.operators.relational import contains_any


def why(entries: DataFrame, commits: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(origin, id, at, text): decisions and refactorings that mention the text, and commits whose message does, newest first."""
    told = entries.filter(F.col("kind").isin("decision", "refactor")).filter(contains_any(text, "text")).select(F.lit("ledger").alias("origin"), "id", "at", "text")
    done = commits.filter(contains_any(text, "text")).select(F.lit("commit").alias("origin"), "id", "at", "text")
    return told.union(done).orderBy(F.desc("at"), "origin", "id").limit(limit)


def history(entries: DataFrame, text: str | None = None, since=None, columns: tuple[str, ...] = ("text", "kind"), limit: int = 50) -> DataFrame:
    """Entries that mention the text in one of the columns, from a time on, newest first."""
    rows = entries if text is None else entries.filter(contains_any(text, *columns))
    rows = rows if since is None else rows.filter(F.col("at") >= F.lit(since))
    return rows.orderBy(F.desc("at"), "id").limit(limit)


def in_scope(constraints: DataFrame, scopes: list[str]) -> DataFrame:
    """The newest constraint of each rule in the scopes, newest first."""
    rank = F.row_number().over(W.partitionBy("scope", "rule_id").orderBy(F.desc("at"), "id"))
    return constraints.filter(F.col("scope").isin(*scopes)).withColumn("rank", rank).filter("rank = 1").drop("rank").orderBy(F.desc("at"), "id")


def _climbed(links: DataFrame) -> DataFrame:
    """links (step_id, up, hops, least, done), each step joined with what its farthest known ancestor knows."""
    above = links.select(F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
    met = links.filter("NOT done").join(above, "up")
    both = met.select("step_id", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
    return saved(links.filter("done").union(both))


#: Steps of a path that are put together before they are set behind the path of the step above them.
PATH_STEPS = 16


def _with_paths(first: DataFrame, rooted: DataFrame) -> DataFrame:
    """rooted (step_id, root, depth) with path; first: (step_id, up).

    Each step gets the end of its path, from the nearest step above whose depth is a multiple of PATH_STEPS; then whole paths go from one
    such step to the next ones.  So only every PATH_STEPS-th step's path is moved, and the others are written once, beside those
    that begin alike.  Chains of such steps are put together by the same means: rounds grow with the logarithm of the depth.
    """
    most = rooted.agg(F.max("depth")).first()[0] or 0
    steps = rooted.join(first.select("step_id", "up"), "step_id").withColumn("part", F.col("step_id").cast("string"))
    return _joined(saved(steps), most).select("step_id", "root", "depth", "path")


def _joined(steps: DataFrame, most: int) -> DataFrame:
    """steps (step_id, up, root, depth, part), depths up to `most` counted in links, with path: the parts from the root to the step."""
    if most == 0:
        return steps.withColumn("path", F.col("part"))
    # A tail is the part of a step and of those above it, `far` links in all; doubled until it ends below a multiple of PATH_STEPS.
    far = F.when(F.col("depth") == 0, 0).otherwise((F.col("depth") - 1) % PATH_STEPS + 1)
    tails = steps.select("step_id", "up", "root", "depth", F.col("part").alias("tail"), F.when(F.col("depth") == 0, 0).otherwise(1).alias("n"), far.alias("far"))
    reached = 1
    while reached < min(most, PATH_STEPS):
        above = tails.select(F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("tail").alias("tail2"), F.col("n").alias("n2"))
        met = tails.join(above, "up", "left")
        more = F.col("n") < F.col("far")
        tails = saved(met.select(
            "step_id", F.when(more, F.col("up2")).otherwise(F.col("up")).alias("up"), "root", "depth",
            F.when(more, F.concat_ws("/", "tail2", "tail")).otherwise(F.col("tail")).alias("tail"),
            F.when(more, F.col("n") + F.col("n2")).otherwise(F.col("n")).alias("n"), "far",
        ))
        reached *= 2
    heads = tails.filter("depth > 0").select(F.col("up").alias("step_id")).distinct()
    marked = tails.join(heads, "step_id", "left_semi")
    level = F.ceil(F.col("depth") / PATH_STEPS).cast("long")
    marked = saved(marked.select("step_id", "up", "root", level.alias("depth"), F.col("tail").alias("part")))
    whole = _joined(marked, -(-(most - 1) // PATH_STEPS)).select(F.col("step_id").alias("up"), F.col("path").alias("head"))
    below = tails.filter("depth > 0").join(whole.hint("shuffle_merge"), "up").withColumn("path", F.concat_ws("/", "head", "tail"))
    top = tails.filter("depth = 0").withColumn("path", F.col("tail"))
    out = ("step_id", "up", "root", "depth", "path")
    return top.select(*out).union(below.select(*out))


def step_tree(steps: DataFrame) -> DataFrame:
    """(step_id, root, depth, path, on_cycle): every step once, whatever the depth; steps whose parent is unknown are roots.

    Ancestors are found by doubling: each round joins a step with its ancestor's ancestor, so rounds grow with the logarithm of
    the depth.  A round that brings no step to a root shows that what is left leads into cycles of parents; there the root is the
    cycle's least step, depth and path are null, and on_cycle tells the cycle's own steps from those below it.
    Of repeated steps the least parent counts; a null step is none.
    """
    own = saved(steps.filter("step_id IS NOT NULL").groupBy("step_id").agg(F.min("parent_step_id").alias("parent")))
    known = own.select(F.col("step_id").alias("parent"), F.lit(True).alias("known"))
    linked = own.join(known, "parent", "left")
    up = F.when(F.col("known"), F.col("parent")).otherwise(F.col("step_id"))
    roots = linked.select("step_id", up.alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("hops"), F.least("step_id", up).alias("least"), F.col("known").isNull().alias("done"))
    first = saved(roots)
    links, open_ = first, first.filter("NOT done").count()
    while open_:
        links = _climbed(links)
        left = links.filter("NOT done").count()
        if left == open_:
            break
        open_ = left
    rooted = links.filter("done").select("step_id", F.col("up").alias("root"), F.col("hops").alias("depth"))
    tree = _with_paths(first, saved(rooted)).withColumn("on_cycle", F.lit(False))
    if not open_:
        return tree
    # Beyond as many hops as there are steps left, an ancestor is on the cycle, and the least step on the way from it is the cycle's.
    lost = links.filter("NOT done")
    while lost.filter(F.col("hops") < open_).limit(1).count():
        lost = _climbed(lost)
    ring = saved(lost.select(F.col("up").alias("member")).distinct())
    least = lost.select(F.col("step_id").alias("up"), F.col("least").alias("root"))
    told = lost.join(least, "up").join(ring.select(F.col("member").alias("step_id"), F.lit(True).alias("on")), "step_id", "left")
    return tree.union(told.select("step_id", "root", F.lit(None).cast("long"), F.lit(None).cast("string"), F.coalesce("on", F.lit(False))))


def open_proposals(proposals: DataFrame, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Proposals not yet applied, of some kinds, surest first."""
    rows = proposals.filter("applied_at IS NULL")
    rows = rows.filter(F.col("kind").isin(*kinds)) if kinds else rows
    return rows.orderBy(F.desc("confidence"), "id").limit(limit)


def applied(proposals: DataFrame, done: DataFrame) -> DataFrame:
    """The proposals with applied_at set where done (id, at) names them."""
    return proposals.join(done.select("id", F.col("at").alias("now")), "id", "left").withColumn("applied_at", F.coalesce("applied_at", "now")).drop("now")


def hydrated(names: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(qualified_name, file_path, community_id) of names; null where nothing is known, the largest id where a node has several."""
    single = members.groupBy("qualified_name").agg(F.max("community_id").alias("community_id"))
    return names.select("qualified_name").distinct().join(nodes.select("qualified_name", "file_path"), "qualified_name", "left").join(single, "qualified_name", "left")


def as_of(versions: DataFrame, key: str, at: str, when: Column) -> DataFrame:
    """The row of each key as it was at a time."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))
    return versions.filter(F.col(at) <= when).withColumn("rank", rank).filter("rank = 1").drop("rank")


def latest_or(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """The newest snapshot (at, nodes, edges), or the live counts where there is none."""
    newest = snapshots.orderBy(F.desc("at")).limit(1).select(F.lit("snapshot").alias("origin"), "nodes", "edges")
    found = newest.agg(F.count("*").alias("n"))
    return newest.union(live.select(F.lit("live").alias("origin"), "nodes", "edges").crossJoin(F.broadcast(found)).filter("n = 0").drop("n"))  # one row each


def hybrid_fallback(entries: DataFrame, nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, origin, score) by the first word of the query alone: ledger hits 0.75, then nodes 0.55."""
    word = (query.split() or [""])[0]
    told = entries.filter(contains_any(word, "text")).select(F.col("id").cast("string").alias("id"), F.lit("ledger").alias("origin"), F.lit(0.75).alias("score"))
    seen = nodes.filter(contains_any(word, "name")).select(F.col("qualified_name").alias("id"), F.lit("graph").alias("origin"), F.lit(0.55).alias("score"))
    return told.union(seen).orderBy(F.desc("score"), "id").limit(limit)
