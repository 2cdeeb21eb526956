"""An index of inverted lists for nearest neighbours by cosine: trained centroids, probed lists, exact scores.

Centroids come from k-means over a bounded hashed sample; every row is then laid in the list of its nearest centroid, with the
list's radius beside it: the widest angle between a row and the centroid. Rows are ranged by list and id and packed in blocks, so
a list that holds a third of all rows is many blocks in many tasks. A query meets the blocks of its ``probes`` nearest lists by an
equality join and is scored exactly there. Which rows are read grows with probes times rows over lists, and there are as many lists
as the root of the rows. How many lists a query has to search depends on how the rows lie, so it is measured: for a bounded number
of drawn rows the exact neighbours among all rows are found, and ``probes`` is the least number that holds TARGET of them.

``exact`` adds a second round: by the triangle inequality of angles no row of a list is nearer to a query than the angle to its
centroid less its radius, so lists that could still hold a better row than the k-th found are searched too and nothing is lost.

Edge cases: null vectors are in no list; zero vectors are at a right angle to all and lie in a list that the second round always
searches; ties go to the smaller id; repeated rows each count; an empty table gives an empty result. Vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.plan import durable, small
from graphloom.operators.retrieval import top

#: Rows that k-means learns from, lists at most, rows a block, query blocks that are sent to every task.
SAMPLE, MOST_LISTS, BLOCK, MOST_SENT = 100_000, 16_384, 2_048, 256
#: Rows that are asked for the exact neighbours that set the probes, how many each, and the share of them to hold.
ASKED, NEIGHBOURS, TARGET = 256, 10, 0.95


class Index(NamedTuple):
    """``centroids`` (lists by length, unit or zero), ``radii`` in radians, and ``blocks`` (list, ids, values) of all rows; a search takes ``probes`` lists."""

    centroids: np.ndarray
    radii: np.ndarray
    blocks: DataFrame
    probes: int


def _unit(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centroids(rows: DataFrame, lists: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres of k-means over at most about ``sample`` rows (id, vector), drawn by a hash of the id."""
    known = rows.where(F.col("vector").isNotNull() & (F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0))
    n = known.count()
    if n == 0:
        width = rows.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
        return np.zeros((1, width[0] if width else 1))
    drawn = known if n <= sample else known.where(F.pmod(F.xxhash64("id", F.lit("centroids")), F.lit(n)) < sample)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    points = drawn.select(array_to_vector(F.transform("vector", lambda x: x / norm)).alias("features"))
    return _unit(np.array(KMeans(k=max(2, lists), seed=seed, maxIter=10).fit(points).clusterCenters()))


def _probes(laid: DataFrame, centres: np.ndarray, target: float) -> int:
    """The least number of nearest lists that holds this share of the exact neighbours of drawn rows, from (list, id, vector)."""
    drawn = laid.orderBy(F.xxhash64("id", "vector"), "id").limit(ASKED).select("vector").toArrow()
    if not drawn.num_rows:
        return 1
    asked = _matrix(drawn.column(0).combine_chunks())
    places = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    shared = laid.sparkSession.sparkContext.broadcast((asked, places))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, place = shared.value
        for batch in source:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                scores, lists = ask @ _matrix(part.column(2)).T, part.column(0).to_numpy()
                best = np.argsort(-scores, axis=1, kind="stable")[:, :NEIGHBOURS]
                query = np.repeat(np.arange(len(ask)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(place[query, lists[best].ravel()])], names=["query_id", "score", "place"])

    nearest = top(laid.select("list", "id", "vector").mapInArrow(batches, "query_id long, score double, place long"), ["query_id"], NEIGHBOURS, F.desc("score"), F.col("place"))
    needed = nearest.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a list at most
    held = np.cumsum([r["n"] for r in needed])
    return int(needed[int(np.searchsorted(held, target * held[-1]))]["place"]) + 1


def build(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """The index of all rows (id, vector)."""
    held = rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where(F.col("vector").isNotNull())
    n = held.count()
    centres = centroids(held, lists or max(1, min(MOST_LISTS, round(n**0.5))), sample)
    shared = held.sparkSession.sparkContext.broadcast(centres)

    def assigned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                values = _unit(_matrix(part.column(1)))
                scores = values @ shared.value.T
                nearest = scores.argmax(axis=1)
                zero = ~values.any(axis=1)
                nearest[zero] = 0
                angles = np.where(zero, np.pi, np.arccos(np.clip(scores[np.arange(len(values)), nearest], -1, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel())), pa.array(angles)], names=["list", "id", "vector", "angle"])

    laid = durable(held.mapInArrow(assigned, "list int, id long, vector array<double>, angle double"))
    radii = np.zeros(len(centres))
    for r in laid.groupBy("list").agg(F.max("angle").alias("r")).collect():  # a row a list
        radii[r["list"]] = r["r"]

    def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            lists_ = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, lists_[1:] != lists_[:-1]))
            cuts = sorted({*edges.tolist(), *range(0, len(lists_), BLOCK), len(lists_)})
            values = _matrix(batch.column(2))
            spans = list(zip(cuts, cuts[1:]))
            ids = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([lists_[a] for a, _ in spans], pa.int32()), pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int64())), pa.array([values[a:b].ravel() for a, b in spans], pa.list_(pa.float64()))], names=["list", "ids", "values"])

    ranged = laid.select("list", "id", "vector").repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    return Index(centres, radii, durable(ranged.mapInArrow(packed, "list int, ids array<long>, values array<double>")), _probes(laid, centres, target))


def _asked(queries: DataFrame, index: Index, choose) -> DataFrame:  # noqa: ANN001
    """(list, query_ids, query_values): queries (id, vector, ...) beside the lists that ``choose(scores, batch)`` marks."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                values = _unit(_matrix(part.column(1)))
                scores = values @ shared.value[0].T
                rows, lists = np.nonzero(choose(scores, shared.value[1], part))
                order = np.argsort(lists, kind="stable")
                rows, lists = rows[order], lists[order]
                edges = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])).tolist() if len(lists) else []
                ids = part.column(0).to_numpy()
                spans = list(zip(edges, [*edges[1:], len(lists)]))
                yield pa.RecordBatch.from_arrays([pa.array([lists[a] for a, _ in spans], pa.int32()), pa.array([ids[rows[a:b]] for a, b in spans], pa.list_(pa.int64())), pa.array([values[rows[a:b]].ravel() for a, b in spans], pa.list_(pa.float64()))], names=["list", "query_ids", "query_values"])

    return queries.mapInArrow(batches, "list int, query_ids array<long>, query_values array<double>")


def _met(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, id, score): of each block that a query meets, its k best rows."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                ask, own = (np.asarray(batch.column(c)[i].values) for c in (0, 2))
                a, b = (np.asarray(batch.column(c)[i].values).reshape(len(x), -1) for c, x in ((1, ask), (3, own)))
                scores = np.round(a @ b.T, 6)
                best = np.array([np.lexsort((own, -row))[:k] for row in scores])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ask, best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query_id", "id", "score"])

    pairs = index.blocks.join(small(asked, MOST_SENT), "list").select("query_ids", "query_values", "ids", "values")
    return pairs.mapInArrow(batches, "query_id long, id long, score double")


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows most alike to each query (id, vector) among those of its nearest lists, or of all."""
    asked = queries.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where(F.col("vector").isNotNull())
    probes = probes or index.probes

    def nearest(scores: np.ndarray, radii: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        marked = np.zeros(scores.shape, bool)
        np.put_along_axis(marked, np.argsort(-scores, axis=1, kind="stable")[:, :probes], True, axis=1)
        return marked

    best = lambda rows: top(rows, ["query_id"], k, F.desc("score"), F.col("id"))
    first = best(_met(_asked(asked, index, nearest), index, k))
    if not exact:
        return first
    first = durable(first)
    worst = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
    again = asked.join(worst, asked.id == worst.query_id, "left").select("id", "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst"))

    def open_(scores: np.ndarray, radii: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        most = np.cos(np.maximum(0.0, np.arccos(np.clip(scores, -1, 1)) - radii - 1e-6))
        return (most >= part.column(2).to_numpy()[:, None] - 2e-6) & ~nearest(scores, radii, part)

    return best(first.select("query_id", "id", "score").union(_met(_asked(again, index, open_), index, k)))
