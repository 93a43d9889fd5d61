"""Queries by key, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.found[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return put


#: The graph views of lodegraph.sources.tables, for the SQL side.
NODES = """
SELECT 'r:' || r_regionkey AS qualified_name, r_name AS name, 'region' AS kind, 'region/' || r_regionkey AS file_path FROM region
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation', 'nation/' || n_nationkey FROM nation
UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer', 'customer/' || c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', 'supplier/' || s_suppkey FROM supplier
UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', 'part/' || p_partkey FROM part
"""
ORDER_EDGES = """
SELECT 'orders' AS kind, 'c:' || o_custkey AS source, 'p:' || l_partkey AS target, l_quantity AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
CONTAINMENT = """
SELECT 'contains' AS kind, 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 1.0::DOUBLE AS weight FROM nation
UNION ALL SELECT 'contains', 'c:' || c_custkey, 'n:' || c_nationkey, 1.0::DOUBLE FROM customer
UNION ALL SELECT 'contains', 's:' || s_suppkey, 'n:' || s_nationkey, 1.0::DOUBLE FROM supplier
"""
GRAPH = f"WITH nodes AS ({NODES}), edges AS ({ORDER_EDGES} UNION ALL {CONTAINMENT})"
MEMBERS = """
SELECT 'c:' || c_custkey AS qualified_name, (c_nationkey % 5)::BIGINT AS community_id FROM customer
UNION ALL SELECT 'p:' || p_partkey, (5 + p_size % 5)::BIGINT FROM part
UNION ALL SELECT 's:' || s_suppkey, (s_nationkey % 5)::BIGINT FROM supplier
"""
