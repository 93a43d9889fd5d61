"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; a session on one machine may do without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The scopes that are open.
_open: list[Scratch] = []


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A scope at whose end all that written() wrote in it is deleted, but for the last table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.pop()
        for path in self.paths[:-1]:
            self.delete(path)

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def small(batches, rows: int = 256):
    """Arrow batches a few rows at a time: what a task holds as Python objects stays small, however Spark cuts its batches.

    A worker lives on for later tasks, so what Arrow holds in reserve is given back at the end.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    pa.default_memory_pool().release_unused()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_bucket(column, bits: int):
    """The top bits of a column's 64-bit hash, as an int: buckets of near-equal size whatever the values are."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits).cast("int")


def mark(key, rest, seed: int) -> Column:
    """A 63-bit hash of a row: 39 bits of its key, 24 of the rest.  Rows that repeat both have the same."""
    high = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1).bitwiseAND(F.lit(~0xFFFFFF))
    return high.bitwiseOR(F.xxhash64(rest).bitwiseAND(F.lit(0xFFFFFF)))


def lowest(rows: DataFrame, mark: Column, most: int) -> Column:
    """What holds for the rows whose mark is among the `most` smallest different marks of rows.

    So a sample is bounded whatever repeats, and is empty only if rows is.  Most rows are passed over by their mark alone.
    """
    n = rows.count()
    for share in sorted({min(1.0, 4 * most / max(1, n)), 1.0}):
        some = rows.select(mark.alias("mark"))
        some = some.filter(F.col("mark") < F.lit(int(share * (1 << 53)) << 10)) if share < 1 else some
        found, last = some.distinct().orderBy("mark").limit(most).agg(F.count("*"), F.max("mark")).first()
        if found == most or share == 1:
            return mark <= F.lit(last) if found else F.lit(False)
    raise AssertionError


#: A filter has FILTER_RATE bits a key, between these powers of two (16 MB at most), sent as pieces of 4 KB.
FILTER_RATE, LEAST_BITS, MOST_BITS, PIECE_BITS = 16, 18, 27, 15


@dataclass
class Filter:
    """A bitmap of hashes: (piece, map), 2**(bits - PIECE_BITS) pieces at most."""

    pieces: DataFrame
    bits: int


def sized_filter(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> Filter:
    """A filter of the values of a column.  Beyond 2**most_bits / FILTER_RATE keys it lets more and more through: it
    only ever spares work, the join behind it decides."""
    bits = min(most_bits, max(LEAST_BITS, (FILTER_RATE * keys.count()).bit_length()))
    at = hash_bucket(column, bits)
    places = keys.select(F.shiftright(at, PIECE_BITS).alias("piece"), at.bitwiseAND((1 << PIECE_BITS) - 1).alias("bit"))
    return Filter(places.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map")), bits)


def unused(df: DataFrame, name: str) -> str:
    """A name like this that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list:
    """All columns, for select(), whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def parted(df: DataFrame, column, filter_: Filter) -> tuple[DataFrame, DataFrame]:
    """(the rows whose value of the column (of the type of the filter's) it may hold, those that it clears); its size is bounded, so it is broadcast."""
    at = hash_bucket(column, filter_.bits)
    piece, map_ = unused(df, "piece"), unused(df, "map")
    met = df.withColumn(piece, F.shiftright(at, PIECE_BITS)).join(
        F.broadcast(filter_.pieces.select(F.col("piece").alias(piece), F.col("map").alias(map_))), piece, "left"
    )
    bit = at.bitwiseAND((1 << PIECE_BITS) - 1)
    byte = F.conv(F.hex(F.substring(F.col(map_), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return met.filter(maybe).select(*columns_of(df)), met.filter(~maybe).select(*columns_of(df))
