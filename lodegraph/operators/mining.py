"""Conventions and intents inferred from files and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions.names import style
from lodegraph.operators.relational import glob_pattern, majority


def naming_conventions(symbols: DataFrame, scope: str, name: str) -> DataFrame:
    """The naming style of each scope, where four in five names and three at least have it."""
    found = majority(symbols.withColumn("__style", style(F.col(name))), [scope], "__style")
    return found.orderBy(F.desc("confidence"), scope)


def violations(symbols: DataFrame, conventions: DataFrame, scope: str, name: str) -> DataFrame:
    """Names of another style than their scope's convention."""
    met = symbols.join(conventions.select(scope, F.col("value").alias("expected")), scope)
    return met.withColumn("found", style(F.col(name))).filter("found <> expected")


def first_claim(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Of several claims on a key, the one from the source that comes first."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def change_intents(commits: DataFrame, now: DataFrame, churn: float = 200, days: int = 90, old_days: int = 365, few: int = 2) -> DataFrame:
    """(file, intent, confidence) from commits (file, committed_at, lines[, message, todos]).

    frozen 0.8 if the last message says so, frozen 0.6 if untouched for a year with few commits, deferred 0.5 with much recent change
    (and three open to-dos, where todos are known).
    """
    message = F.col("message") if "message" in commits.columns else F.lit(None).cast("string")
    todos = F.col("todos") if "todos" in commits.columns else F.lit(3)
    rows = commits.withColumn("__m", message).withColumn("__t", todos).crossJoin(F.broadcast(now))  # one row
    late = F.col("committed_at") >= F.col("now") - F.make_dt_interval(F.lit(days))
    per = rows.groupBy("file", "now").agg(
        F.count("*").alias("n"), F.max("committed_at").alias("last"), F.sum(F.when(late, F.col("lines"))).alias("recent"),
        F.max_by("__m", "committed_at").alias("m"), F.max("__t").alias("t"),
    )
    frozen = F.lower("m").rlike("do not touch|frozen|don't touch")
    old = (F.col("last") < F.col("now") - F.make_dt_interval(F.lit(old_days))) & (F.col("n") <= few)
    busy = (F.col("recent") >= churn) & (F.col("t") >= 3)
    intent = F.when(frozen, "frozen").when(old, "frozen").when(busy, "deferred")
    sure = F.when(frozen, 0.8).when(old, 0.6).when(busy, 0.5)
    return per.select("file", intent.alias("intent"), sure.alias("confidence")).filter("intent IS NOT NULL")


#: Words that mark a file's intent in its first lines, with the kind that they mean (fixed values).
INTENT_MARKS = (("frozen", "frozen|do not edit|do not modify"), ("deprecated", "deprecated"), ("experimental", "experimental|prototype"), ("deferred", "deferred|todo later"))


def annotated_intents(files: DataFrame, text: str = "text", lines: int = 30) -> DataFrame:
    """(file, intent, reason) of files with `@intent: kind reason` or a known mark in their first lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    said = F.regexp_extract(head, r"(?i)@intent:?\s*([a-z_]+)", 1)
    kind: Column = F.when(said != "", F.lower(said))
    for name, pattern in INTENT_MARKS:
        kind = kind.when(head.rlike(f"(?i)(^|\n)\\s*(//|#|\\*).*({pattern})"), name)
    reason = F.regexp_extract(head, r"(?i)@intent:?\s*[a-z_]+\s*[-—:]?\s*([^\n]*)", 1)
    return files.select("file", kind.alias("intent"), F.trim(reason).alias("reason")).filter("intent IS NOT NULL")


def test_framework(path: Column) -> Column:
    """The test framework that a file's name speaks of, null for other files."""
    return (
        F.when(path.rlike(r"\.(test|spec)\.[jt]sx?$"), "jest").when(path.rlike(r"(^|/)test_[^/]+\.py$|_test\.py$"), "pytest")
        .when(path.rlike(r"(^|/)tests/[^/]+\.rs$|_test\.rs$"), "cargo").when(path.rlike(r"_test\.go$"), "go")
    )


def glob_intents(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(file, intent, confidence) by the first rule (glob, intent) that a file fits."""
    kind: Column | None = None
    for glob, intent in rules:
        fits = F.col("file").rlike(glob_pattern(glob))
        kind = F.when(fits, intent) if kind is None else kind.when(fits, intent)
    return files.select("file", kind.alias("intent"), F.lit(0.9).alias("confidence")).filter("intent IS NOT NULL")


def written_intents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(file, intent, reason) from lines `- name: kind - reason` of documents."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\s*-\s+`?([^:`\s]+)`?:\s*([a-z]+)(?:\s+[-—]\s+(.*))?$", i)
    return lines.select(part(1).alias("file"), part(2).alias("intent"), part(3).alias("reason")).filter("file <> ''")


def observed(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, functions, types, imports_first, exports, tests_beside): what a file shows of its conventions."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 60), "\n")
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return files.select(
        "path", n(r"\b(?:function|fn|def)\s+[A-Za-z_]").alias("functions"), n(r"\b(?:interface|struct|enum|class)\s+[A-Z]").alias("types"),
        F.regexp_count(head, F.lit(r"(?m)^(?:import|use|from)\s")).cast("long").alias("imports"), n(r"(?m)^export\b").alias("exports"),
        F.col("path").rlike(r"\.(?:test|spec)\.|(?:^|/)tests?/").alias("is_test"),
    )
