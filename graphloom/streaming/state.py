"""Keyed state as processors: a working set a conversation that waits for late rows and ends when idle, and a ring a key.

``transformWithState`` needs a store that holds more than one state a key: set ``spark.sql.streaming.stateStore.providerClass`` to
``STORE``. State lies in that store on local disk and in the query's checkpoint folder, so a conversation is not bounded by memory,
only what has not been folded yet is held at once.

A time to live goes by processing time, for which Spark runs empty batches as long as a query runs: a run over what is there
(``availableNow``) ends only with ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.combat import touched

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class WorkingSets(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, are folded in order of time and number into a map, and leave when idle."""

    def __init__(self, most: int, idle_ms: int) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "name string", "how string, turn long")
        self.waiting = handle.getListState("waiting", "at long, seq long, name string, how string, turn long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(_ms(r.ts), int(r.seq), r.name_, r.how, int(r.turn)) for frame in rows for r in frame.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            last = max(r[0] for r in new)
            if self.last.exists():
                last = max(last, self.last.get()[0])
            self.last.update((last,))
            # The timer of the end moves on with the last row; the rows are folded when it, or one before it, fires.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        self._fold(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"conv_id": [], "name": [], "how": [], "turn": []}).astype({"conv_id": "int64", "name": "object", "how": "object", "turn": "int64"})

    def _fold(self, watermark: int) -> None:
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= watermark]
        if not ready:
            return
        held = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        before = set(held)
        for _, _, name, how, turn in ready:
            held = touched(held, name, how, turn, self.most)
        for name in before - held.keys():
            self.held.removeKey((name,))
        for name, value in held.items():
            self.held.updateValue((name,), value)
        rest = rows[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._fold(timerValues.getCurrentWatermarkInMs())
        held = sorted((k[0], v[0], v[1]) for k, v in self.held.iterator())
        for state in (self.held, self.waiting, self.last):
            state.clear()
        yield pd.DataFrame({"conv_id": [key[0]] * len(held), "name": [n for n, _, _ in held], "how": [h for _, h, _ in held], "turn": [t for _, _, t in held]})

    def close(self) -> None:
        pass


def working_sets(touches: DataFrame, most: int, late: str, idle_ms: int) -> DataFrame:
    """(conv_id, name, how, turn): each conversation's working set when it has had no touch for ``idle_ms`` of event time.

    Touches are (conv_id, seq, ts, name, how, turn). Their order is that of time, then number, not of arrival: a row may come
    ``late`` and is still folded in its place, later ones are left out. The result is that of ``combat.working_sets`` over the same rows. A
    conversation that goes on after its end begins anew. Rows with a null are left out.
    """
    rows = touches.select("conv_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("name").alias("name_"), "how", F.col("turn").cast("long").alias("turn")).dropna()
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("conv_id").transformWithStateInPandas(WorkingSets(most, idle_ms), "conv_id long, name string, how string, turn long", "append", "EventTime")


class Ring(StatefulProcessor):
    """The last so many values of a key, as a list that the store forgets ``ttl_ms`` after its last write (never, if None)."""

    def __init__(self, size: int, ttl_ms: int | None) -> None:
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[tuple[int, str]] = []
        for frame in rows:
            new = sorted([*new, *zip(frame.event_id, frame.event_type)])[-self.size :]
        last = [*(r[0] for r in self.held.get()), *(v for _, v in new)][-self.size :]
        self.held.put([(v,) for v in last])
        yield pd.DataFrame({"user_id": [key[0]], "last": [",".join(last)]})

    def close(self) -> None:
        pass


def ring(events: DataFrame, size: int, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, last): the last ``size`` event types of each user after each batch."""
    rows = events.select("user_id", "event_id", "event_type").dropna()
    return rows.groupBy("user_id").transformWithStateInPandas(Ring(size, ttl_ms), "user_id long, last string", "update", "ProcessingTime" if ttl_ms else "None")
