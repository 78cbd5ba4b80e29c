"""Micro-batches by size or time: a batch closes when it is full or when its first request is too old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def assign(times: list[float], size: int, seconds: float, number: int = -1, first: float = 0.0, used: int = 0) -> tuple[list[int], int, float, int]:
    """Batch number of each request time, in order, and the open batch's state."""
    out = []
    for t in times:
        if number < 0 or used >= size or t - first > seconds:
            number, first, used = number + 1, t, 0
        used += 1
        out.append(number)
    return out, number, first, used


def batches(requests: DataFrame, queue: str, at: str, order: str, size: int = 16, seconds: float = 1.0) -> DataFrame:
    """(queue, order, batch) of a table; a queue is one run in order of time, walked piece by piece with the open batch kept."""

    def run(pieces):
        now, state = None, (-1, 0.0, 0)
        for rows in pieces:
            found = []
            for own, times in rows.groupby((rows[queue] != rows[queue].shift()).cumsum())["_t"]:
                name = rows.at[times.index[0], queue]
                state = state if name == now else (-1, 0.0, 0)
                now = name
                numbers, *state = assign(times.tolist(), size, seconds, *state)
                found += numbers
            yield rows[[queue, order]].assign(batch=found)

    kinds = dict(requests.dtypes)
    seconds_of = (F.unix_micros(F.col(at).cast("timestamp")).cast("double") / 1e6).alias("_t")
    runs = requests.where(F.col(queue).isNotNull()).select(queue, order, seconds_of).repartition(queue).sortWithinPartitions(queue, "_t", order)
    return runs.mapInPandas(run, f"`{queue}` {kinds[queue]}, `{order}` {kinds[order]}, batch long")


def stream_batches(requests: DataFrame, queue: str, order: str, size: int = 16, seconds: float = 1.0, idle: int | None = None) -> DataFrame:
    """The same on a stream of (queue, order, _t); the open batch is kept as state.

    With ``idle``, a queue without a request for so many milliseconds is forgotten and its batches begin at 0 again.
    """
    kinds = dict(requests.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pool = pd.concat(list(parts)).sort_values(["_t", order])
        number, first, used = state.get if state.exists else (-1, 0.0, 0)
        found, number, first, used = assign(pool["_t"].tolist(), size, seconds, number, first, used)
        state.update((number, first, used))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({queue: pool[queue], order: pool[order], "batch": found})

    schema = f"`{queue}` {kinds[queue]}, `{order}` {kinds[order]}, batch long"
    return requests.groupBy(queue).applyInPandasWithState(run, schema, "number long, first double, used long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
