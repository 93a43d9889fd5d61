"""Queries of the stored full-text index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.functions.stem import stem_sql
from lodegraph.operators import fulltext
from lodegraph.operators.graph import folder
from lodegraph.plans.registry import Registry
from lodegraph.sources.tables import table

Q = Registry()

TOKENS = f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{fulltext.ACCENTED}', '{fulltext.PLAIN}'),
  '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t), vocabulary AS (SELECT DISTINCT word FROM each)"""
STEMMED = f"WITH {TOKENS}, {stem_sql('vocabulary')}, p AS (SELECT doc_id, stem AS term, pos FROM each JOIN stems USING (word))"


def _index(spark, d):
    return fulltext.build_index(table(spark, d, "documents"), "doc_id", ["text"], f"{folder(spark)}/index-{uuid.uuid4().hex}")


@Q.add("R2_stemmed_index", f"{STEMMED} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def stemmed_index(spark, d):
    return _index(spark, d).terms.select("term", "df", "cf")


def _has(alias: str, term: str, prefix: bool) -> str:
    return f"starts_with({alias}.term, '{term}')" if prefix else f"{alias}.term = '{term}'"


#: Of each dialect: the query, how its phrases join, whether their last words are beginnings, and its stemmed phrases.
DIALECTS = {
    "prefix and": ("edition thou", "and", True, [["edit"], ["thou"]]),
    "prefix or": ("wheres edation", "or", True, [["where"], ["edat"]]),
    "words and": ("The AND of", "and", False, [["the"], ["and"], ["of"]]),
    "phrase": ('"of the"', "and", False, [["of", "the"]]),
    "phrase prefix": ('"of the" "and th" que', "or", True, [["of", "the"], ["and", "th"], ["que"]]),
}


def _phrase_sql(phrase: list[str], prefix: bool) -> str:
    """(doc_id, pos): where the phrase begins."""
    joins = "".join(f" JOIN p p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND " + _has(f"p{i}", x, prefix and i == len(phrase) - 1) for i, x in enumerate(phrase) if i)
    return f"SELECT p0.doc_id, p0.pos FROM p p0{joins} WHERE " + _has("p0", phrase[0], prefix and len(phrase) == 1)


def _dialect_sql() -> str:
    parts = []
    for name, (_, join, prefix, phrases) in DIALECTS.items():
        sets = [f"(SELECT DISTINCT doc_id FROM ({_phrase_sql(p, prefix)}))" for p in phrases]
        parts.append(f"SELECT '{name}' AS dialect, doc_id FROM (" + (" INTERSECT " if join == "and" else " UNION ").join(sets) + ")")
    return f"{STEMMED} " + " UNION ALL ".join(parts)


@Q.add("R4_dialects", _dialect_sql())
def dialects(spark, d):
    index, found = _index(spark, d), None
    for name, (query, join, prefix, _) in DIALECTS.items():
        hits = fulltext.search(index, query, join, prefix).select(F.lit(name).alias("dialect"), F.col("key").alias("doc_id"))
        found = found.union(hits) if found is not None else hits
    return found


@Q.add(
    "R6_ranked_full_text",
    f"""{STEMMED}, h AS (SELECT 0 AS phrase, doc_id, count(*) AS n FROM ({_phrase_sql(['of', 'the'], False)}) GROUP BY doc_id
      UNION ALL SELECT 1, doc_id, count(*) FROM p WHERE term = 'edat' GROUP BY doc_id),
    s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_tokens FROM t), df AS (SELECT phrase, count(*) AS df FROM h GROUP BY phrase)
    SELECT h.doc_id, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) * n_docs / n_tokens))), 6) AS score
    FROM h JOIN df USING (phrase) JOIN t USING (doc_id), s GROUP BY h.doc_id ORDER BY score DESC, h.doc_id""",
)
def ranked_full_text(spark, d):
    found = fulltext.ranked(_index(spark, d), '"of the" edation', "or", limit=None)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
