"""The stemmer and the stored full-text index."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegraph.functions.stem import stem, stem_sql, stemmed
from lodegraph.operators import fulltext

#: Words and stems from the published description of the algorithm, and words at the edges of its rules.
STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi
sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic
differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis
hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal
electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop
adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog
communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
controll:control roll:roll yes:ye yearly:yearli is:is by:by y:y oed:o dying:dy syzygy:syzygi running:run apologies:apolog generalizations:gener""".split()


@pytest.fixture(scope="module")
def stems(spark):
    return spark.createDataFrame([tuple(x.split(":")) for x in STEMS], "word string, want string")


def test_stems(stems):
    got = stemmed(stems.withColumn("got", F.col("word")), "got").collect()
    assert {r.word: r.got for r in got} == {r.word: r.want for r in got}


def test_stems_in_sql(stems):
    con = duckdb.connect()
    con.register("v", stems.select("word").toArrow())
    assert dict(con.sql(f"WITH {stem_sql('v')} SELECT word, stem FROM stems").fetchall()) == {r.word: r.want for r in stems.collect()}


TEXTS = [
    (1, "Parsing the parsers' pool", "one"),
    (2, "A parser: pools, pooled!", None),
    (3, "the pool of parsers", "parse trees"),
    (4, "Élan vital, élan", ""),
    (5, None, None),
    (6, "blast_radius of the blast", "the pool"),
    (7, "pool the", "pool x" * 3),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(TEXTS, "id long, text string, more string")
    return fulltext.build_index(docs, "id", ["text", "more"], f"file://{tmp_path_factory.mktemp('index')}", buckets=8)


@pytest.mark.parametrize("query,join,prefix,want", [
    ("parsing pools", "and", False, {1, 3}),
    ("parser", "and", False, {1, 2, 3}),
    ("par", "and", False, set()),
    ("par", "and", True, {1, 2, 3}),
    ("p", "and", True, {1, 2, 3, 6, 7}),
    ("elan zzz", "or", False, {4}),
    ("elan zzz", "and", False, set()),
    ('"the pool"', "and", False, {3, 6}),
    ('"pool the"', "and", False, {7}),
    ('"the pool" ÉLAN', "or", False, {3, 4, 6}),
    ("blast_radius", "and", False, {6}),
    ("blast_rad", "and", True, {6}),
    ("radius_blast", "and", False, set()),
    ("blast", "and", True, {6}),
    ("of the the", "and", False, {3, 6}),
    ("", "and", False, set()),
    ("?! _", "or", True, set()),
])
def test_dialects(index, query, join, prefix, want):
    assert {r.key for r in fulltext.search(index, query, join, prefix).collect()} == want
    assert {r.key for r in fulltext.ranked(index, query, join, prefix, None).collect()} == want


def test_rank_is_by_weight_and_length(index):
    got = fulltext.ranked(index, "pool parse", "or").collect()
    assert [r.key for r in got][0] in (1, 2, 3) and len(got) == 5
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert index.stats.first().n_docs == 7


def test_a_query_reads_its_buckets_alone(index):
    found = fulltext.search(index, "elan")
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,elan\)", plan)
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.postings.filter(F.col("bucket") == index.bucket_of("elan")).inputFiles()}
    assert str(index.bucket_of("elan")) in files
    assert index.postings.filter(F.col("term") == "elan").select("bucket").distinct().collect()[0].bucket == index.bucket_of("elan")


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id string, text string")
    made = fulltext.build_index(none, "id", ["text"], f"file://{tmp_path}/index")
    assert fulltext.ranked(made, "a b", "or").collect() == [] and made.stats.first().n_docs == 0


def test_stems_of_the_function(stems):
    assert [x for x in STEMS if stem(x.split(":")[0]) != x.split(":")[1]] == []
    odd = ["élan", "ys", "yyyed", "ßing", "12ing", "x" * 70 + "ing", "agreed~", "漢字s"]
    got = stemmed(stems.sparkSession.createDataFrame([(w, w) for w in odd], "word string, got string"), "got").collect()
    assert {r.word: r.got for r in got} == {w: stem(w) for w in odd}


def test_an_index_is_made_in_one_pass_over_the_texts(spark, tmp_path):
    """Finding ranges of terms, or counting words for the statistics, would split and stem all texts once more."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(TEXTS * 100, "id long, text string, more string").mapInArrow(watched, "id long, text string, more string")
    made = fulltext.build_index(docs.withColumn("id", F.monotonically_increasing_id()), "id", ["text", "more"], f"file://{tmp_path}/index", buckets=8)
    assert made.stats.first().n_docs == 700 and made.stats.first().n_tokens == made.terms.agg(F.sum("cf")).first()[0]
    assert seen.value == 2 * 700  # the postings, and the count of texts
