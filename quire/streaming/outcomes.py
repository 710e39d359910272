"""Outcomes of rows as a stream, taken in exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    def __init__(self, order: str, kind: str, terminal: list[str], ttl_ms: int | None):
        self.order, self.kind, self.terminal, self.ttl_ms = order, kind, terminal, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            part = part[part[self.kind].isin(self.terminal)]
            if len(part):
                part = part.sort_values(self.order, kind="stable").head(1)
                best = part if best is None or part[self.order].iloc[0] < best[self.order].iloc[0] else best
        if best is not None and not self.taken.exists():
            self.taken.update((True,))
            yield best

    def close(self) -> None:
        pass


def first_outcomes(ticks: DataFrame, key: str, order: str, kind: str, terminal: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The first terminal tick of each row of a stream; later ones of the row are passed over.

    The session needs the state store STORE.  A row's state is one mark; with ttl_ms it is forgotten that long after
    the outcome, and a terminal tick that comes still later counts anew.  Of terminal ticks of one batch the
    first by order is taken.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields)
    mode = "processingTime" if ttl_ms is not None else "none"
    return ticks.groupBy(key).transformWithStateInPandas(_Once(order, kind, terminal, ttl_ms), schema, "append", mode)


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own number: a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingested(outcomes: DataFrame, path: str, checkpoint: str):
    """Starts taking outcomes into a table at path; read it with spark.read.parquet(path)."""
    return outcomes.writeStream.foreachBatch(batch_table(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
