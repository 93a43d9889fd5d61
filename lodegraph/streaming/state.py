"""Operators that keep state of their own for each key of a stream (they need the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The setting of a session that runs these operators, by name.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastSamples(StatefulProcessor):
    """The last n samples of a key by (time, tie) and their percentiles by floor(q * n), not interpolated."""

    def __init__(self, n: int, shares: tuple[float, ...]) -> None:
        self.n, self.shares = n, shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at timestamp, tie long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame(list(self.kept.get()), columns=["at", "tie", "value"])
        for batch in rows:  # a batch of any length leaves n rows at most
            new = batch[["at", "tie", "value"]].dropna(subset=["value"])
            both = pd.concat([held, new]) if len(held) else new
            held = both.sort_values(["at", "tie"], kind="stable").tail(self.n)
        if not len(held):
            return
        self.kept.put([(a.to_pydatetime(), int(t), float(v)) for a, t, v in held.itertuples(index=False)])
        values = sorted(held["value"])
        at = [values[min(int(q * len(values)), len(values) - 1)] for q in self.shares]
        yield pd.DataFrame([(*key, len(values), *at)], columns=["key", "n", *[f"p{round(q * 100)}" for q in self.shares]])

    def close(self) -> None:
        pass


def last_percentiles(events: DataFrame, key: str, ts: str, tie: str, value: str, n: int = 256, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(key, n, p50, p95, p99) of the last n samples of each key, again whenever it has new ones; null values are no samples.

    State is n rows a key, whatever the stream; a key's batch is read in pieces.
    """
    rows = events.selectExpr(f"CAST({key} AS STRING) AS key", f"{ts} AS at", f"CAST({tie} AS LONG) AS tie", f"CAST({value} AS DOUBLE) AS value")
    out = "key string, n long, " + ", ".join(f"p{round(q * 100)} double" for q in shares)
    return rows.groupBy("key").transformWithStateInPandas(LastSamples(n, shares), out, "Update", "None")
