from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGE = [
    (1, "One two three four five six seven"),
    (2, "one TWO three four five six seven"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "short text"),
    (7, "short text"),
    (8, "short text"),
    (8, "short text"),
    (None, "short text"),
    (9, LONG),
    (10, LONG + " end"),
    (11, "<|endoftext|> İstanbul Straße Σίσυφος ΣΑΣ é    naïve 漢字かな 🙂🙂 it's 12,345!!"),
    (12, " ".join(f"u{i}" for i in range(70))),
    (13, " ".join(f"u{i}" for i in range(30, 110))),
    (14, "word " * 90),
    (15, "x" * 5000),
]
#: Names that operators use for columns of their own.
CLASHING = "digest gram n g pos key row rank shard part bucket block slot at arc length votes score ids words spans __rank __piece kept v vals cols comp map mix_id mix_at grp cls tk maybe piece".split()


def table_of(spark, rows):
    """Documents with further columns, whose names clash with those that operators make."""
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "web" if (i or 0) % 3 else "", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def edge(spark):
    return table_of(spark, EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return table_of(spark, [])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
