"""Stateful processors: exact sliding rates of a stream, and texts that pass once whatever the run.

Both need a session with the RocksDB state store (see PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The session setting that both processors need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RATES = "key string, event long, at timestamp, n long"


class _Rates(StatefulProcessor):
    """Events wait until the watermark has passed them; then all that came before them is known and they are counted.

    State of a key: the events that wait, and the times of the last `seconds` before the watermark.
    """

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event long, at long")
        self.log = handle.getListState("log", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["event", "at"]] for r in rows])
        self.waiting.appendList(list(zip(new["event"].tolist(), new["at"].tolist(), strict=True)))
        self.handle.registerTimer(-(-int(new["at"].min()) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [x for x in waiting if x[1] <= mark], [x for x in waiting if x[1] > mark]
        before = [x[0] for x in self.log.get()] if self.log.exists() else []
        times = np.sort(np.array(before + [x[1] for x in ready], np.int64))
        self._put(self.waiting, later)
        self._put(self.log, [(int(t),) for t in times[times >= mark - self.span]])
        if later:
            self.handle.registerTimer(-(-min(x[1] for x in later) // 1000))
        if ready:
            at = np.array([x[1] for x in ready], np.int64)
            n = np.searchsorted(times, at, side="right") - np.searchsorted(times, at - self.span, side="left")
            yield pd.DataFrame({"key": key[0], "event": [x[0] for x in ready], "at": pd.to_datetime(at, unit="us"), "n": n})

    def _put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def sliding_rate(events: DataFrame, key: str, event: str, at: str, seconds: int, limit: int, late: str) -> DataFrame:
    """A stream's events (a number, a key, a time) with n, the key's events in the seconds up to each, and limited: rows as
    windows.sliding_rate gives for the stored events, in whatever order they arrive.

    An event is given out when the watermark, `late` behind the newest event, has passed it; one that comes later than that is dropped.
    An event without a key is let through and not counted: it has no rows here.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(event).cast("long").alias("event"), F.col(at).cast("timestamp").alias("time"))
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    out = rows.groupBy("key").transformWithStateInPandas(_Rates(seconds), RATES, "Append", "EventTime")
    return out.withColumn("limited", F.col("n") > limit)


class _Once(StatefulProcessor):
    """Passes a key's first row; keys of the initial state have passed before."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield every.sort_values(self.names, kind="stable").head(1)[self.names]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_texts(rows: DataFrame, stored: DataFrame | None = None, hash_column: str = "text_hash") -> DataFrame:
    """Rows of a stream whose hash comes for the first time: neither before in the stream nor among `stored` hashes.

    Of rows that come together with one hash the first in the order of their columns passes. The state is kept with the
    stream's checkpoint, so a restart passes nothing twice; a run with a checkpoint of its own begins with what is
    stored. Rows without a hash pass never.
    """
    names = rows.columns
    grouped = rows.where(F.col(hash_column).isNotNull()).withColumn("__key", F.col(hash_column)).groupBy("__key")
    begun = stored.where(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("__key")).distinct().groupBy("__key") if stored is not None else None
    return grouped.transformWithStateInPandas(_Once(names), rows.schema, "Append", "None", initialState=begun)
