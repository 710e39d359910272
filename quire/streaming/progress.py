"""Progress ticks as streams: terminal rows stay closed, values only rise, outcomes are taken in once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rising(ticks: DataFrame, key: str, order: str, value: str, kind: str, terminal: list[str], idle_ms: int | None = None) -> DataFrame:
    """Ticks that raise their row's value, until the row's first terminal tick, which is passed on.

    The state of a row is its highest value and whether it has ended; later ticks never reopen it.  With idle_ms
    the state of a row that has had no tick for so long is given up, and a later tick begins anew.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields)

    def step(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, ended = state.get if state.exists else (0.0, False)
        part = pd.concat(list(parts)).sort_values(order, kind="stable")
        done = np.flatnonzero(part[kind].isin(terminal))
        last = -1 if ended else int(done[0]) if len(done) else len(part)  # ticks behind it are late
        part, seen = part.iloc[: last + 1], part[value].to_numpy(np.float64)[: last + 1]
        before = np.fmax.accumulate(np.r_[best, seen])
        keep = seen > before[:-1]
        keep[last : last + 1] = True  # the terminal tick, if there is one
        ended = ended or len(done) > 0
        state.update((float(before[-1]), bool(ended)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield part[keep]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return ticks.groupBy(key).applyInPandasWithState(step, schema, "best double, ended boolean", "append", timeout)


def republished(ticks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch of a stream to the sink, which must take a batch number twice without harm."""
    return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
