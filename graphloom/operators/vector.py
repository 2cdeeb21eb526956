"""Exact nearest neighbours by cosine, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.plan import small
from graphloom.operators.retrieval import top

BLOCK, MOST_BLOCKS = 2_048, 64


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, values): rows packed BLOCK at a time where they lie, scaled to unit length; zero vectors stay zero."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = np.array(part.column(1).to_pylist(), np.float64)
                norms = np.linalg.norm(values, axis=1, keepdims=True)
                values = values / np.where(norms == 0, 1.0, norms)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()]), pa.array([values.ravel().tolist()])], names=["ids", "values"])

    return rows.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(batches, "ids array<long>, values array<double>")


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows most alike to each query, from (id, vector) of one length.

    Every query meets every row: blocks of the query set meet blocks of the rows, one matrix product a pair, and k rows a query
    and block leave the task. The query blocks, some megabyte each, are counted: up to ``MOST_BLOCKS`` are sent to every task, more
    are paired partition by partition. The work is queries times rows, so the query set is what a caller keeps small.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for ids, values, others, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.array(values).reshape(len(ids), -1)
                b = np.array(matrix).reshape(len(others), -1)
                scores = np.round(a @ b.T, 6)
                keys = np.array(others)
                out = []
                for i, q in enumerate(ids):
                    best = np.lexsort((keys, -scores[i]))[:k]
                    out += [(q, int(keys[j]), float(scores[i, j])) for j in best]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], names=["query_id", "id", "score"])

    left = _blocks(queries).toDF("query_ids", "query_values")
    pairs = _blocks(rows).crossJoin(small(left, MOST_BLOCKS)).select("query_ids", "query_values", "ids", "values").mapInArrow(batches, "query_id long, id long, score double")
    return top(pairs, ["query_id"], k, F.desc("score"), F.col("id"))
