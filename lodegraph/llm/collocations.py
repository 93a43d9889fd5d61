"""Phrase collocations by Apriori: level k emits a k-gram only where both of its overlapping (k-1)-grams are frequent.

Each level is one pass over the whole texts.  Tasks get the frequent (k-1)-grams as a bitmap of their hashes, whose size is
bounded (2**MOST_BITS bits); it may let some more through, never fewer, and counts are of the phrases themselves, so they are
exact at every size.  Tasks add up what they emit before it is shuffled.  The frequent phrases of a level are written as its
table; scores come from joins of the level tables alone.

Words are runs of bytes other than space and tab, within the pieces between `[.,;:!?\\x0A-\\x0D]`, with A-Z lower-cased.  All
is counted in each language by itself.

Defined cases: a null text counts as empty; a null language counts as `und`; repeated rows count each; texts of any length
are read in blocks that share the words at their seam; an empty table, and one without frequent phrases, give an empty
result; equal scores rank by count, then by the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import small, written
from lodegraph.llm.words import PLACES, hashes, mix

#: What ends a piece, and the byte it becomes, which UTF-8 never has.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + MARK * len(ENDS))
SEAM = re.compile(rb"[ \t\xff]")
MARK_HASH = hashes([MARK])[0]

#: Bytes of a text that are split at once, and distinct phrases that a task adds up before it hands them on.
BLOCK_BYTES, ENTRIES = 1 << 20, 200_000

#: The bitmap has 16 bits a key between these powers of two (32 MB at most), gathered in pieces of 4 KB.
LEAST_BITS, MOST_BITS, PIECE_BITS = 18, 28, 15

#: A language's phrases are ranked in so many lots first, of which each hands on no more than are asked for.
LOTS = 64

_COUNTED = "lang string, gram binary, n long"


def blocks(raw: bytes, k: int):
    """Lists of words and marks that hold each run of k words once, but for runs within the k - 1 words at a list's start."""
    raw, at, tail = raw.translate(FOLD), 0, []
    while at < len(raw):
        cut = SEAM.search(raw, at + BLOCK_BYTES)
        end = cut.start() if cut else len(raw)
        words = tail + raw[at:end].replace(MARK, b" " + MARK + b" ").split()
        yield words
        at, tail = end, words[max(0, len(words) - k + 1) :] if k > 1 else []


def gram_hashes(w: np.ndarray, k: int, lang: int) -> np.ndarray:
    """Of the runs of k words at every place, in one language."""
    h = np.full(max(0, len(w) - k + 1), lang, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * PLACES[i]
    return mix(h)


def _places(words: list[bytes], k: int, lang: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Where a k-gram starts in one piece, both of whose (k-1)-grams the bitmap holds."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    w = hashes(words)
    bit = gram_hashes(w, k - 1, lang) >> np.uint64(64 - bits)
    held = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
    marks = np.zeros(len(w) + 1, np.int32)
    for i in np.flatnonzero(w == MARK_HASH):
        marks[i + 1] = words[i] == MARK
    marks = np.cumsum(marks)
    return np.flatnonzero((held[:-1] & held[1:]).astype(bool) & (marks[k:] == marks[:-k]))


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in range(len(c))]
    grams = [g for c in counts.values() for g in c]
    return pa.record_batch([pa.array(langs, pa.string()), pa.array(grams, pa.binary()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "gram", "n"])


def _emitter(k: int, bits: int, bitmap):
    """Counts of a level's candidates; at level 1 the empty phrase counts all words."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                own = counts.setdefault(lang, Counter())
                seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
                for words in blocks(text.as_py(), k):
                    if k == 1:
                        own.update(words)
                        own[b""] += len(words) - own.pop(MARK, 0)
                    else:
                        at = _places(words, k, seed, bitmap.value, bits).tolist()
                        own.update([b" ".join(words[i : i + k]) for i in at])
                    if sum(map(len, counts.values())) > ENTRIES:
                        yield _counted(counts)
                        own = counts[lang] = Counter()
                        counts = {lang: own}
        yield _counted(counts)

    return run


def _bits(k: int, bits: int):
    """The bit of each frequent k-gram."""

    def run(batches):
        for batch in small(batches, 10_000):
            found = []
            for lang, gram in zip(batch.column("lang").to_pylist(), batch.column("gram").cast(pa.binary()), strict=True):
                h = gram_hashes(hashes(gram.as_py().split(b" ")), k, np.uint64(xxhash.xxh3_64_intdigest(lang)))
                found.append(int(h[0] >> np.uint64(64 - bits)))
            yield pa.record_batch([pa.array(found, pa.int64())], ["bit"])

    return run


def frequent_filter(level: DataFrame, k: int):
    """(bits, broadcast bitmap) of the frequent k-grams; what reaches the driver has 2**MOST_BITS bits at most."""
    spark = level.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * level.count()).bit_length()))
    at = level.select("lang", "gram").mapInArrow(_bits(k, bits), "bit long")
    at = at.select(F.shiftright("bit", PIECE_BITS).alias("piece"), F.col("bit").bitwiseAND((1 << PIECE_BITS) - 1).alias("bit"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for piece, part in at.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("part")).collect():
        first = piece << (PIECE_BITS - 3)
        bitmap[first : first + len(part)] = np.frombuffer(part, np.uint8)
    return bits, spark.sparkContext.broadcast(bitmap)


def level_tables(spark: SparkSession, docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language: lang, n), and of each level the frequent phrases: lang, gram, f, k."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    levels, totals, bits, bitmap = [], None, 0, None
    for k in range(1, longest + 1):
        counts = texts.mapInArrow(_emitter(k, bits, bitmap), _COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("f"))
        kept = written(counts.filter((F.col("f") >= least) | (F.octet_length("gram") == 0)).select("lang", F.col("gram").cast("string").alias("gram"), "f"), f"level-{k}")
        if bitmap is not None:
            bitmap.unpersist()
        if k == 1:
            totals = kept.filter("gram = ''").select("lang", F.col("f").alias("n"))
            kept = kept.filter("gram <> ''")
        levels.append(kept.withColumn("k", F.lit(k)))
        if k < longest:
            bits, bitmap = frequent_filter(kept, k)
    return totals, levels


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def mine(spark: SparkSession, docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first `top` phrases by the score of their worst cut.

    A phrase is left out where one a word longer has `covered` percent of its count or more: one longer still has no more
    than that, and is frequent only if that is.
    """
    totals, levels = level_tables(spark, docs, least, longest)
    counts = _all(levels).select("lang", "gram", "f")
    phrases = _all(levels[1:])
    words = phrases.select("lang", "gram", F.col("f").alias("a"), "k", F.split("gram", " ", -1).alias("w")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = words.select(
        "lang", "gram", "a", "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    cuts = cuts.join(counts.select("lang", F.col("gram").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r)").cast("long")
    worst = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    longer = _all(levels[2:] or [phrases.limit(0)]).withColumn("w", F.split("gram", " ", -1))
    inner = [F.array_join(F.slice("w", F.lit(i), F.col("k") - 1), " ") for i in (1, 2)]
    longer = longer.select("lang", "f", F.explode(F.array_distinct(F.array(*inner))).alias("gram")).groupBy("lang", "gram").agg(F.max("f").alias("over"))
    kept = worst.join(longer, ["lang", "gram"], "left").filter("over IS NULL OR 100 * CAST(over AS DECIMAL(20,0)) < %d * CAST(a AS DECIMAL(20,0))" % covered)
    order = [F.col("x.score").desc(), F.col("a").desc(), F.col("gram")]
    lots = kept.withColumn("lot", F.pmod(F.xxhash64("gram"), F.lit(LOTS)))
    lots = lots.withColumn("at", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).filter(F.col("at") <= top)
    ranked = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "x.l", "x.r", "n", "x.score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
  FROM candidates c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, h.f AS l, t.f AS r, ((2000000 * a::HUGEINT) // (h.f + t.f))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM worst s WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = s.lang AND length(c.phrase) > length(s.phrase)
      AND 100 * c.a >= 80 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
