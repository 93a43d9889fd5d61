"""Session memory: turns, ledger entries and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.sketch import cosine
from lodegraph.operators.relational import contains_any

#: What marks the kind of a turn, tried in this order (fixed values).
QUESTION = r"\?\s*$"
DECISION = r"(?i)\b(?:decid(?:ed|e) to|chose|picked|went with|opting for|selected)\s+([^.\n]{3,80})"
DECISION_OVER = r"(?i)\b(?:we)\s+over\s+([^.\n]{3,80})"
BUG = r"(?i)\b(?:bug|broken|crash|error|fails?|regression|symptom)\b"
REFACTOR = r"(?i)\b(?:refactor(?:ed|ing)?|rewrote|extracted|renamed|moved)\b"
EXPERIMENT = r"(?i)\b(?:tried|experiment(?:ed|ing)?|prototyped|spiked)\b"
RATIONALE = r"(?i)\b(?:because|so that|to ensure|in order to|rationale[:\s])\s+([^.\n]{3,160})"
FIRST_SENTENCE = r"^[^.!?\n]{4,}?[.!?]"
FILE_PATH = r"(?:[a-zA-Z]:\\(?:[\w.\-]+\\)*[\w.\-]+|/(?:[\w.\-]+/)*[\w.\-]+)"


def turn_kind(said: Column, asked: Column) -> Column:
    has = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    return (
        F.when(has(F.trim(said), QUESTION), "open_question").when(has(said, DECISION) | has(said, DECISION_OVER), "decision")
        .when(has(asked, BUG) | has(said, BUG), "bug").when(has(said, REFACTOR), "refactor").when(has(said, EXPERIMENT), "experiment").otherwise("impl")
    )


def distill(turns: DataFrame) -> DataFrame:
    """One ledger entry for each assistant turn (session, turn, role, text), with the user turn right before it."""
    w = W.partitionBy("session").orderBy("turn")
    rows = turns.withColumn("asked", F.when(F.lag("role").over(w) == "user", F.lag("text").over(w))).filter("role = 'assistant'")
    said, asked = F.col("text"), F.coalesce("asked", F.lit(""))
    first = F.regexp_extract(said, FIRST_SENTENCE, 0)
    paths = F.regexp_extract_all(F.concat_ws("\n", asked, said), F.lit(FILE_PATH), 0)
    return rows.select(
        "session", "turn", turn_kind(said, asked).alias("kind"),
        F.when(first != "", F.trim(first)).otherwise(F.trim(F.substring(said, 1, 160))).alias("summary"),
        F.nullif(F.trim(F.regexp_extract(said, RATIONALE, 1)), F.lit("")).alias("rationale"),
        F.array_distinct(F.filter(paths, lambda p: F.length(p) >= 3)).alias("touched_files"),
    )


def search_turns(turns: DataFrame, query: str, session=None, limit: int = 50) -> DataFrame:
    """Turns that hold the query, newest first."""
    rows = turns.filter(contains_any(query, "text"))
    rows = rows if session is None else rows.filter(F.col("session") == session)
    return rows.orderBy(F.desc("turn"), "session").limit(limit)


def resume(entries: DataFrame, session: str = "session", sizes: dict[str, int] | None = None) -> DataFrame:
    """What a session needs to go on: its last entries as timeline, and the last of each kind, tagged by section."""
    sizes = sizes or {"timeline": 50, "decision": 10, "impl": 10, "refactor": 10, "open_question": 20}
    parts = []
    for section, n in sizes.items():
        rows = entries if section == "timeline" else entries.filter(F.col("kind") == section)
        rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc("turn")))
        parts.append(rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(F.lit(section).alias("section"), session, "turn", "kind", "summary", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def recall(entries: DataFrame, key: str, recency: str, hits: DataFrame, limit: int = 10) -> DataFrame:
    """The recent entries together with those that a search hit, each once, hits first, then newest."""
    pool = max(4 * limit, 20)
    recent = entries.orderBy(F.desc(recency), key).limit(pool).select(key)
    ids = recent.union(hits.select(key)).distinct()
    met = entries.join(ids, key, "left_semi").join(hits.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    return met.orderBy(F.coalesce("hit", F.lit(0)).desc(), F.desc(recency), key).limit(limit)


def semantic_recall(entries: DataFrame, key: str, recency: str, embedding: str, asked: list[float], hits: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The entries nearest to an asked vector by cosine, of the newest ones and the newest of those that a search hit; with `score`.

    Both pools hold 4 * limit entries, 20 at least.  An entry without a vector scores 0; ties: newest first, then by key.
    """
    pool = max(4 * limit, 20)
    newest = lambda df: df.orderBy(F.desc(recency), key).limit(pool)
    ids = newest(entries).select(key)
    if hits is not None:
        ids = ids.union(newest(entries.join(hits.select(key), key, "left_semi")).select(key)).distinct()
    score = F.coalesce(cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in asked])), F.lit(0.0))
    return entries.join(ids, key, "left_semi").withColumn("score", score).orderBy(F.desc("score"), F.desc(recency), key).limit(limit)


def first_of(parts: list[DataFrame], limit: int = 1) -> DataFrame:
    """The rows of the first part that has any: each part is a fallback of those before it."""
    out = None
    for i, p in enumerate(parts):
        one = p.limit(limit).withColumn("__rank", F.lit(i))
        out = one if out is None else out.union(one)
    best = out.agg(F.min("__rank").alias("__best"))
    return out.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")  # one row


def parents_first(steps: DataFrame) -> DataFrame:
    return steps.orderBy(F.when(F.col("parent_step_id").isNull(), 0).otherwise(1), "step_id")


def net_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(added, removed, modified) between two snapshots, by key and digest, in one pass over both."""
    a = old.select(F.col(key).alias("k"), F.col(digest).alias("a"), F.lit(1).alias("in_a"))
    b = new.select(F.col(key).alias("k"), F.col(digest).alias("b"), F.lit(1).alias("in_b"))
    met = a.join(b, "k", "full")
    return met.agg(
        F.count_if(F.col("in_a").isNull()).alias("added"),
        F.count_if(F.col("in_b").isNull()).alias("removed"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("modified"),
    )


def skill_scores(query: str, skills: DataFrame, limit: int = 5) -> DataFrame:
    """Skills (name, triggers, tags) by 2 for each trigger word and 1 for each tag word of the query; with a confidence band."""
    asked = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    hit = lambda c: F.size(F.array_intersect(F.transform(c, F.lower), asked))
    score = 2 * hit(F.col("triggers")) + hit(F.col("tags"))
    band = F.when(F.col("score") >= 3, "high").when(F.col("score") >= 1, "medium").otherwise("low")
    return skills.withColumn("score", score).withColumn("confidence", band).filter("score > 0").orderBy(F.desc("score"), "name").limit(limit)
