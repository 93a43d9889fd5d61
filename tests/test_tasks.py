"""Tasks of joins over order lines grow in number with the lines."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL

from lodegraph.plans import catalog
from lodegraph.sources import tables


def test_tasks_of_order_lines_grow_with_the_lines(spark, monkeypatch):
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "ROWS_A_TASK", n // 10)
    assert tables.order_edges(spark, SMALL).rdd.getNumPartitions() >= 10
    plan = catalog.queries()["J3_A3_edges_of_file"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 1[01]\)", plan)


def test_neighbours_meet_pairs_as_numbers(spark, duck):
    """No aggregate over pairs of names, and pairs are counted once for both directions."""
    found = catalog.queries()["J4_neighbours"](spark, SMALL)
    want = dict(duck.execute(catalog.oracle_sql()["J4_neighbours"]).fetchall())
    assert {r.self: r.neighbours for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [self#" in plan and "other" not in plan


@pytest.mark.parametrize("name", ["C1_C5_scan_text", "C1_C2_C3_C4_C5_C12_findings"])
def test_scans_use_all_cores(spark, name):
    """A table of files has few splits, but its texts are scanned in as many tasks as there are cores."""
    assert catalog.queries()[name](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
