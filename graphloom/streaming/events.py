"""Event-time streams: windows with watermarks, duplicates within a watermark, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType, TimestampType


def stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def wall_times(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as the wall time of UTC, without a zone. Where it has none it is that already."""
    if events.schema["ts"].dataType != TimestampType():
        return events
    return events.withColumn("ts", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(unix_micros(ts) AS DECIMAL(20, 0)) / 1000000)"))


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Only a watermark asks for instants. Wall times without a zone stay: as instants they would follow the session's zone, where
    an hour of spring is missing and one of autumn comes twice."""
    if late is None and events.schema["ts"].dataType == TimestampNTZType():
        return events
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def _without_time(events: DataFrame, late: str | None) -> DataFrame | None:
    """Events of a batch that have no time: windows leave them out, so they are counted beside them."""
    return None if late or events.isStreaming else events.where(F.col("ts").isNull())


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums of windows; with ``late``, windows close that long after their end.

    In a batch, events without a time are counted under a start that is null.
    """
    timed, rest = _timed(events, late), _without_time(events, late)
    counts = F.count("*").alias("n"), F.sum("value").alias("total")
    found = timed.groupBy(F.window("ts", length), "event_type").agg(*counts).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    return found if rest is None else found.unionByName(rest.groupBy("event_type").agg(*counts).withColumn("start", F.lit(None).cast(found.schema["start"].dataType)))


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    timed = _timed(events, late)
    return timed.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events with no gap of that length; in a batch, an event without a time is one by itself."""
    timed, rest = _timed(events, late), _without_time(events, late)
    found = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
    return found if rest is None else found.unionByName(rest.select("user_id", F.lit(None).cast(found.schema["start"].dataType).alias("start"), F.lit(1).cast("long").alias("n")))


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch of a user's events: a keyed state of a count and a sum."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def ring(events: DataFrame, size: int) -> DataFrame:
    """(user_id, last): the last ``size`` event types of each user, as keyed state."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = [*held, *batch.sort_values("event_id").event_type][-size:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "last": [",".join(held)]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, last string", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def drain(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all there is and stop; results are in the memory table ``name``."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
