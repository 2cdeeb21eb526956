"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the character n-grams a text has (lower case, white space runs as one space), hashed. Each is scaled by its
naive Bayes log-count ratio: the log of how much likelier a toxic text is to hold it than another. A logistic regression over
the scaled features (of unit length in each text, and not standardised again) is the classifier.

The ratios are counted over all labelled rows that may be learned from: one vector a task, summed by place. The regression uses
a bounded sample of them, ``MOST_TOXIC`` and ``MOST_OTHER`` in expectation, chosen by a hash of the id: one task descends over it, EPOCHS times in a fixed order with falling steps. The score then undoes the sample's class balance
by shifting the intercept. The driver holds vectors of 2^BITS numbers.
Scoring is one pass over whole texts where they lie; the model is broadcast, its size is fixed.

Edge cases: a null or empty text gets the score of no features but the ends. Rows without a label, or with a null label, are
scored but not learned from; a label that repeats counts once, and of labels that conflict toxic wins. With labels of one class only, or none, every score is that
class's share (0.0 with none). Rows that repeat an id are scored each. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, sample_rate, text_of
from graphloom.llm.ngrams import counted

ORDERS, BITS, SMOOTH = (3, 4, 5), 18, 20.0
MOST_TOXIC, MOST_OTHER, STEP, EPOCHS = 3_000, 6_000, 8.0, 8
THRESHOLD, MOST_SENT = 0.7, 500_000


@dataclass
class Model:
    weights: np.ndarray
    squares: np.ndarray
    intercept: float


def _places(text: str) -> np.ndarray:
    return counted(text, ORDERS, BITS)[0]


def _scale(squares: np.ndarray) -> float:
    """The scaled features of a text get unit length, so that long texts do not outweigh short ones."""
    return 1.0 / math.sqrt(float(squares.sum()) + 1e-9)


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Log of how much likelier a toxic text is to hold a feature; both rates are drawn to the joint rate by SMOOTH texts."""
    joint = (toxic + other) / (n_toxic + n_other)
    rate = lambda held, n: (held + SMOOTH * joint) / (n + SMOOTH)
    seen = joint > 0
    return np.where(seen, np.log(np.where(seen, rate(toxic, n_toxic), 1.0)) - np.log(np.where(seen, rate(other, n_other), 1.0)), 0.0)


def _featured(labelled: DataFrame) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = pa.array([_places(t).astype(np.int32) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["label", "places"])

    return labelled.mapInArrow(batches, "label double, places array<int>")


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the logistic regression over scaled features, by stochastic descent with falling steps."""
    weights, intercept, n, total = np.zeros(len(ratio)), 0.0, 0, EPOCHS * len(rows)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at = rows[i]
            x = ratio[at] * _scale(ratio[at] ** 2)
            error = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, float(weights[at] @ x) + intercept)))) - labels[i]
            step = STEP * (1.0 - n / total) * error
            weights[at] -= step * x
            intercept -= 0.1 * step
            n += 1
    return weights, intercept


def _class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(toxic, other, n_toxic, n_other): how many texts of each class hold each place, over every row of (label, text)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in source:
            for label, text in zip(*(c.to_pylist() for c in batch.columns)):
                held[int(label)][_places(text)] += 1
                rows[int(label)] += 1
        if rows.any():
            places = np.append(np.flatnonzero(held.any(axis=0)), -1)
            counts = [pa.array(np.append(held[k][places[:-1]], rows[k])) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(places), *counts], names=["place", "toxic", "other"])

    found = labelled.mapInArrow(batches, "place long, toxic long, other long")
    sums = found.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas()
    toxic, other = np.zeros(1 << BITS), np.zeros(1 << BITS)
    real = sums[sums.place >= 0]
    toxic[real.place], other[real.place] = real.toxic, real.other
    total = sums[sums.place < 0]
    return toxic, other, float(total.toxic.sum()), float(total.other.sum())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic); pass only the rows that may be learned from."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = sizes.get(1.0, 0) / total if total else 0.0
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), math.inf if share else -math.inf)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    rates = {1.0: sample_rate(sizes[1.0], MOST_TOXIC), 0.0: sample_rate(sizes[0.0], MOST_OTHER)}
    chosen = known.where(F.when(F.col("label") == 1.0, draw < rates[1.0] * 1e6).otherwise(draw < rates[0.0] * 1e6))
    # The sample holds at most a fixed number of ids, so sending them to every task saves moving the texts.
    chosen = F.broadcast(chosen.orderBy(draw, "doc_id").limit(2 * (MOST_TOXIC + MOST_OTHER)))
    rows = _featured(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(chosen, "doc_id").select("label", "text"))
    rows = durable(rows)
    size = 1 << BITS
    drawn = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # Up to a counted number of labels the texts are counted where they lie; beyond it both sides are shuffled by id.
    held = F.broadcast(known) if total <= MOST_SENT else known
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(held, "doc_id").select("label", "text")
    ratio = log_count_ratios(*_class_counts(texts))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        weights, intercept = descend([np.asarray(x, np.int64) for x in group.places], group.label.to_numpy(), shared.value)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.append(used, -1), "weight": np.append(weights[used], intercept)})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "place long, weight double").toPandas()
    weights = np.zeros(size)
    weights[found.place[found.place >= 0]] = found.weight[found.place >= 0]
    intercept = float(found.weight[found.place < 0].sum())
    shift = math.log(sizes[1.0] / sizes[0.0]) - math.log(max(drawn.get(1.0, 0), 1) / max(drawn.get(0.0, 0), 1))
    return Model(weights * ratio, ratio * ratio, intercept + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted): the chance of being toxic, and whether it is at least THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, start = shared.value.weights, shared.value.squares, shared.value.intercept
        for batch in source:
            sums = []
            for text in batch.column(1).to_pylist():
                at = _places(text)
                sums.append(start + float(weights[at].sum()) * _scale(squares[at]))
            with np.errstate(over="ignore"):
                chance = 1.0 / (1.0 + np.exp(-np.array(sums, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, "doc_id long, score double, predicted int")
