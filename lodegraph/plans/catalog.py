"""Every query of the library by key, with SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ("relational", "graphs", "texts", "fulltext", "events", "code", "ledgers")


def _registries() -> list:
    return [importlib.import_module(f"lodegraph.plans.{a}").Q for a in AREAS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in _registries() for k, f in r.found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
