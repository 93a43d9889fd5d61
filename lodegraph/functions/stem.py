"""Porter's stemmer: expressions over words for Spark, SQL for DuckDB and, for the words of Arrow batches, a function, all from the same rules.

A rule is (suffix, [(pattern, tail)]).  In each step the rule of the longest suffix that a word has is taken; of its patterns the first
that matches leaves its first group and the tail; if none does, the word stays.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of consonants and of vowels; y begins a word as consonant (written Y) and is a vowel behind consonants.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, MORE, ONCE, VOWEL = f"(?:{C})?{V}{C}", f"(?:{C})?{V}{C}{V}{C}", f"(?:{C})?{V}{C}(?:{V})?", f"(?:{C})?[aeiouy]"
SHORT = f"{C}[aeiouy][^aeiouwxy]"

#: Suffixes and what stands for them (fixed values of the published algorithm, with its author's later bli and logi).
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _after(condition: str, pairs: str) -> list:
    return [(s, [(f"^({condition}.*){s}$", t)]) for s, _, t in (p.partition(":") for p in pairs.split())]


#: Where "ed" or "ing" went, a tilde stands until the next step.
STEPS = [
    [("sses", [("^(.*ss)es$", "")]), ("ies", [("^(.*i)es$", "")]), ("ss", []), ("s", [("^(.*)s$", "")])],
    [("eed", [(f"^({SOME}.*ee)d$", "")]), ("ed", [(f"^({VOWEL}.*)ed$", "~")]), ("ing", [(f"^({VOWEL}.*)ing$", "~")])],
    [
        *((x + "~", [(f"^(.*{x})~$", "e")]) for x in ("at", "bl", "iz")),
        *((2 * x + "~", [(f"^(.*{x}){x}~$", "")]) for x in "bcdfghjkmnpqrtvwx"),
        ("~", [(f"^({SHORT})~$", "e"), ("^(.*)~$", "")]),
    ],
    [("y", [(f"^({VOWEL}.*)y$", "i")])],
    _after(SOME, STEP_2),
    _after(SOME, STEP_3),
    [*_after(MORE, STEP_4), *((x + "ion", [(f"^({MORE}.*)ion$", "")]) for x in "st")],
    [("e", [(f"^({MORE}.*)e$", ""), (f"^{SHORT}(e)$", "="), (f"^({ONCE})e$", "")])],
    [("ll", [(f"^({MORE}.*)l$", "")])],
]

#: Words of another length stay as they are.
SHORTEST, LONGEST = 3, 64


def _ordered(step: list) -> list:
    return sorted(step, key=lambda rule: -len(rule[0]))


def _steps():
    """Each step with its rules, longest suffix first.  A tail of "=" keeps the word."""
    return map(_ordered, STEPS)


#: By the last letter of a suffix, as a word whose last letter ends no suffix of a step leaves it as it is.
_BY_END = [{x: [(s, [(re.compile(p), t) for p, t in ps]) for s, ps in rules if s[-1] == x] for x in {s[-1] for s, _ in rules}} for rules in _steps()]


@lru_cache(200_000)
def stem(word: str) -> str:
    """What stemmed() makes of a word; those of a task that repeat are stemmed once."""
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    for by_end in _BY_END:
        for suffix, patterns in by_end.get(w[-1], ()):
            if w.endswith(suffix):
                for pattern, tail in patterns:
                    if m := pattern.search(w):
                        w = w if tail == "=" else m[1] + tail
                        break
                break
    return "y" + w[1:] if w[0] == "Y" else w


def stemmed(words: DataFrame, column: str) -> DataFrame:
    """words with the column's words stemmed, one projection for each step, so that no step is written out twice."""
    raw = column + "__raw"
    fits = F.length(raw).between(SHORTEST, LONGEST)
    first = F.when(fits, F.regexp_replace(raw, "^y", "Y")).otherwise("")
    out = words.withColumn(raw, F.col(column)).withColumn(column, first)
    w = F.col(column)
    for rules in _steps():
        changed = F
        for suffix, patterns in rules:
            inner = reduce(lambda rest, p: F.when(w.rlike(p[0]), w if p[1] == "=" else F.concat(F.regexp_extract(w, p[0], 1), F.lit(p[1]))).otherwise(rest), reversed(patterns), w)
            changed = changed.when(w.endswith(suffix), inner)
        out = out.withColumn(column, changed.otherwise(w))
    return out.withColumn(column, F.when(fits, F.regexp_replace(column, "^Y", "y")).otherwise(F.col(raw))).drop(raw)


def stem_sql(vocabulary: str) -> str:
    """Common table expressions `stems` (word, stem) over a relation of words."""
    parts = [f"s0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM {vocabulary})"]
    for n, rules in enumerate(_steps()):
        cases = []
        for suffix, patterns in rules:
            inner = "".join(f" WHEN regexp_matches(w, '{p}') THEN " + ("w" if t == "=" else f"regexp_extract(w, '{p}', 1) || '{t}'") for p, t in patterns)
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN " + (f"CASE{inner} ELSE w END" if inner else "w"))
        parts.append(f"s{n + 1} AS (SELECT word, CASE {' '.join(cases)} ELSE w END AS w FROM s{n})")
    parts.append(f"stems AS (SELECT word, CASE WHEN length(word) BETWEEN {SHORTEST} AND {LONGEST} THEN regexp_replace(w, '^Y', 'y') ELSE word END AS stem FROM s{len(STEPS)})")
    return ", ".join(parts)
