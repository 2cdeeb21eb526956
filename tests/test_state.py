"""Streams with keyed state against the batch fold: late rows, a restart, an end when idle, a time to live."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest

from graphloom.operators import combat
from graphloom.streaming import events, state

TOUCHES = "conv_id long, seq long, ts timestamp, name string, how string, turn long"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, state.STORE)
    yield
    spark.conf.unset(key)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Feed:
    """Files that arrive one by one, each read by a run of the query that starts from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, plan, mode):
        self.spark, self.schema, self.plan, self.mode = spark, schema, plan, mode
        self.folder, self.out, self.kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
        self.n = 0

    def __call__(self, given):
        self.spark.createDataFrame(given, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        query = self.plan(events.stream(self.spark, self.folder, self.schema)).writeStream.outputMode(self.mode)
        query = query.foreachBatch(lambda df, _: df.write.mode("append").parquet(self.out)).option("checkpointLocation", self.kept)
        query.trigger(availableNow=True).start().awaitTermination()
        return rows(self.spark.read.parquet(self.out))


def test_a_stream_gives_the_batch_result(spark, tmp_path):
    draw = random.Random(5)
    touches = [(draw.randrange(4), seq, START + timedelta(seconds=seq), draw.choice("abcdef"), draw.choice(("named", "found")), seq // 5) for seq in range(80)]
    # Rows change places within ten seconds, which the watermark waits for.
    arrived = sorted(touches, key=lambda r: r[1] + draw.random() * 8)
    feed = Feed(spark, tmp_path, TOUCHES, lambda s: state.working_sets(s, 3, "10 seconds", 60_000), "append")
    for i in range(0, 80, 20):
        found = feed(arrived[i : i + 20])
        assert found == []  # no conversation is idle yet
    end = lambda n: (99, 1000 + n, START + timedelta(seconds=400 + 200 * n), "z", "found", 1)
    feed([end(0)])
    found = feed([end(1)])
    kept = rows(combat.working_sets(spark.createDataFrame(touches, TOUCHES), 3))
    assert [r for r in found if r[0] != 99] == kept
    # A row far behind the watermark opens nothing and changes nothing.
    feed([(1, 2000, START, "late", "found", 1), end(2)])
    assert [r for r in feed([end(3)]) if r[0] != 99] == kept
    # A conversation that goes on after its end begins anew.
    feed([(1, 3000, START + timedelta(seconds=2000), "new", "found", 1)])
    found = feed([end(20), (98, None, None, None, None, None)])
    assert [r for r in feed([end(21)]) if r[0] != 99] == sorted([*kept, (1, "new", "found", 1)])


def test_a_ring_goes_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, event_id long, event_type string", lambda s: state.ring(s, 3), "update")
    assert feed([(1, 2, "b"), (1, 1, "a"), (2, 1, "x")]) == [(1, "a,b"), (2, "x")]
    assert (1, "b,c,d") in feed([(1, 3, "c"), (1, 4, "d"), (3, None, "q")])


def test_a_ring_is_forgotten_after_its_time(spark, tmp_path):
    # With processing time Spark would run empty batches for ever, so that a run over what is there would not end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    feed = Feed(spark, tmp_path, "user_id long, event_id long, event_type string", lambda s: state.ring(s, 3, 1000), "update")
    feed([(1, 1, "a")])
    time.sleep(2)
    found = feed([(1, 2, "b")])
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert (1, "b") in found
