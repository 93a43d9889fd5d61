"""The property graph, turns and ledgers as views over the star-schema tables.

Nodes are region, nation, customer, supplier and part rows under a prefixed key; edges are what their foreign keys and
the order lines say.  The edge list is a multigraph: a customer that orders a part twice has two edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = {"region": "r", "nation": "n", "customer": "c", "supplier": "s", "part": "p"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str):
    return F.concat(F.lit(PREFIX[kind] + ":"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qualified_name, name, kind, file_path)"""
    parts = []
    for kind, pre in PREFIX.items():
        at = "key" if kind in ("region", "nation") else {"customer": "custkey", "supplier": "suppkey", "part": "partkey"}[kind]
        column = f"{pre}_{kind}key" if at == "key" else f"{pre}_{at}"
        parts.append(
            table(spark, sf_dir, kind).select(
                key(kind, column).alias("qualified_name"),
                F.col(f"{pre}_name").alias("name"),
                F.lit(kind).alias("kind"),
                F.concat(F.lit(kind + "/"), F.col(column).cast("string")).alias("file_path"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Rows that one task of a join over order lines holds at most, about.
ROWS_A_TASK = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as ROWS_A_TASK asks for, and spark.sql.shuffle.partitions at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))


def spread(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """rows dealt by columns over n tasks, where that is more than a shuffle has anyway."""
    return rows.repartition(n, *columns) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of order lines with their orders.  Tasks grow in number with the lines, not in what one of them holds."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks_for(lines)
    held = lambda df, at: spread(df.select(*sorted({at, *columns} & set(df.columns))), n, at)
    return held(lines, "l_orderkey").join(held(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(*columns)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> part, one edge for each order line."""
    return order_lines(spark, sf_dir, "o_custkey", "l_partkey", "l_quantity").select(
        F.lit("orders").alias("kind"),
        key("customer", "o_custkey").alias("source"),
        key("part", "l_partkey").alias("target"),
        F.col("l_quantity").alias("weight"),
    )


def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region, customer -> nation, supplier -> nation."""
    of = lambda t, kind, a, up, b: table(spark, sf_dir, t).select(
        F.lit("contains").alias("kind"), key(kind, a).alias("source"), key(up, b).alias("target"), F.lit(1.0).alias("weight")
    )
    return (
        of("nation", "nation", "n_nationkey", "region", "n_regionkey")
        .union(of("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .union(of("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, source, target, weight)"""
    return order_edges(spark, sf_dir).union(containment_edges(spark, sf_dir))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qualified_name, community_id): stand-in communities, by nation for customers and suppliers and by size for parts."""
    of = lambda t, kind, a, c: table(spark, sf_dir, t).select(key(kind, a).alias("qualified_name"), c.cast("long").alias("community_id"))
    return (
        of("customer", "customer", "c_custkey", F.col("c_nationkey") % 5)
        .union(of("part", "part", "p_partkey", 5 + F.col("p_size") % 5))
        .union(of("supplier", "supplier", "s_suppkey", F.col("s_nationkey") % 5))
    )
