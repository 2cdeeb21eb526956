"""Forests by interval labels: who lies within whom is a comparison of two numbers, whatever the depth.

A tour enters a node, tours its children in order of their ids, and leaves it. Every step knows the next one from the node's first
child, its next sibling or its parent; where each step lies in its tour follows from pointer doubling, so a chain of a million
nodes takes twenty-one rounds of one equality join. A pointer that has not ended is the only one to its target, so no key of these
joins is hot. Siblings are ranged by parent and id, so the children of one parent may span any number of partitions; of each
partition the driver sees the first row.

Edge cases: a null id is left out; a null parent, or one that is no id, makes a root; of several parents of an id the least counts. Nodes on a cycle, or below
one, have no root and null labels, and lie within nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.plan import durable


def one_parent(parents: DataFrame) -> DataFrame:
    """(id, parent): every id once, those that are only parents too, with a null parent."""
    up = parents.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    only = up.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct().join(up, "id", "left_anti")
    return up.unionByName(only.withColumn("parent", F.lit(None).cast(up.schema["parent"].dataType)))


def _siblings(nodes: DataFrame) -> DataFrame:
    """(id, following): the next child of the same parent, null for the last."""
    laid = durable(nodes.where("parent IS NOT NULL").select("parent", "id").repartitionByRange("parent", "id").sortWithinPartitions("parent", "id"))
    kind = nodes.schema["id"].dataType.simpleString()

    def firsts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *batch.slice(0, 1).columns], names=["part", "parent", "id"])
                return

    heads = {r["part"]: (r["parent"], r["id"]) for r in laid.mapInArrow(firsts, f"part int, parent {kind}, id {kind}").collect()}
    after = {p: heads[min(q for q in heads if q > p)] for p in heads if any(q > p for q in heads)}

    def followed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in source:
            if batch.num_rows:
                if held is not None:
                    yield linked(held, (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()))
                held = batch
        if held is not None:
            yield linked(held, after.get(TaskContext.get().partitionId()))

    def linked(batch: pa.RecordBatch, then: tuple | None) -> pa.RecordBatch:
        parents, ids = (c.to_pylist() for c in batch.columns)
        pairs = [*zip(parents[1:], ids[1:]), then or (None, None)]
        following = [i if q == p else None for p, (q, i) in zip(parents, pairs)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(following, batch.column(1).type)], names=["id", "following"])

    return laid.mapInArrow(followed, f"id {kind}, following {kind}")


def labels(parents: DataFrame) -> DataFrame:
    """(id, root, low, high) from (id, parent): steps of the tour, counted back from its end at 0; a node's lie between its own."""
    nodes = durable(one_parent(parents))
    child = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    # Side 0 enters, side 1 leaves; the step that leaves a root is the end of its tour and points to itself.
    enter = nodes.join(child, "id", "left").select("id", F.lit(0).alias("side"), F.coalesce("child", "id").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done"))
    root = F.col("parent").isNull()
    to = F.coalesce("following", "parent", "id")
    leave = nodes.join(_siblings(nodes), "id", "left").select("id", F.lit(1).alias("side"), to.alias("to"), F.when(F.col("following").isNull(), 1).otherwise(0).alias("to_side"), F.when(root, 0).otherwise(1).cast("long").alias("steps"), root.alias("done"))
    tour = durable(enter.unionByName(leave))
    for _ in range(tour.count().bit_length() + 1):
        open_ = tour.where("NOT done")
        if open_.isEmpty():
            break
        ahead = tour.select(F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("far"), F.col("to_side").alias("far_side"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = open_.join(ahead, ["to", "to_side"]).select("id", "side", F.col("far").alias("to"), F.col("far_side").alias("to_side"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        tour = durable(tour.where("done").unionByName(moved))
    place = lambda side: F.max(F.when((F.col("side") == side) & F.col("done"), -F.col("steps")))
    return tour.groupBy("id").agg(F.max(F.when(F.col("done"), F.col("to"))).alias("root"), place(0).alias("low"), place(1).alias("high"))


def inside(outer: str, inner: str) -> Column:
    """Whether the node whose labels have one prefix lies within that of the other (not a node within itself)."""
    o, i = (lambda c, p=p: F.col(f"{p}_{c}") for p in (outer, inner))
    return F.coalesce((o("root") == i("root")) & (o("low") < i("low")) & (i("high") < o("high")), F.lit(False))


def labelled(pairs: DataFrame, marked: DataFrame, *columns: str) -> DataFrame:
    """Rows with the labels of the nodes in some of their columns, as ``<column>_root``, ``_low`` and ``_high``."""
    for c in columns:
        own = marked.select(F.col("id").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("root", "low", "high")))
        pairs = pairs.join(own, c, "left")
    return pairs


def nearest(parents: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, near): the nearest of an id's ancestors that is marked, itself excepted; null where there is none.

    Each pointer that has met no mark jumps over what its target has jumped over, so the rounds are the logarithm of the depth, with a
    row an id. What is still under way after as many rounds as a chain of all ids needs goes round a cycle without a mark.
    """
    nodes = one_parent(parents)
    held = marks.select(F.col("id").alias("parent"), F.lit(True).alias("marked")).where("parent IS NOT NULL").distinct()
    state = durable(nodes.join(held, "parent", "left").select("id", F.when(F.col("marked"), F.col("parent")).alias("near"), F.when(F.col("marked").isNull(), F.col("parent")).alias("up")))
    for _ in range(state.count().bit_length() + 1):
        open_ = state.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        ahead = state.select(F.col("id").alias("up"), F.col("near").alias("found"), F.col("up").alias("far"))
        moved = open_.join(ahead, "up").select("id", F.col("found").alias("near"), F.col("far").alias("up"))
        state = durable(state.where("up IS NULL").unionByName(moved))
    return state.select("id", F.when(F.col("near") != F.col("id"), F.col("near")).alias("near"))
