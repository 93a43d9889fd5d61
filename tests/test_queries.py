"""Every query with SQL gives the same rows as DuckDB; the others give some columns and don't fail."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import SMALL

from lodegraph.plans import catalog

SQL = catalog.oracle_sql()


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    plain = df[cols].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return plain.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query(spark, duck, key):
    got = catalog.queries()[key](spark, SMALL).toPandas()
    if key in SQL:
        pd.testing.assert_frame_equal(tidy(got), tidy(duck.execute(SQL[key]).df()), check_dtype=False)
    assert len(got.columns)


def test_entry_without_training_data_queries():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
