"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed character n-grams with weight (1 + log count) * idf, of unit length. Document frequencies are counted over
all documents that may be learned from. The weights are trained by follow-the-regularised-leader (per-coordinate steps, L1 and
L2 penalties, so most weights are exactly zero) over a bounded sample: ``PER_LANGUAGE`` documents of each language in
expectation, by a hash of the id, in ``SHARDS`` groups whose weights are averaged. One temperature, which minimises the log
loss on the tenth of the sample that is held back, calibrates the probabilities.

Edge cases: a null text, or one without any letter, is ``und`` with score 0.0. Documents with a null language are predicted
but not learned from. With no language to learn from, all are ``und``. With one, it is always that with score 1.0. Rows that
repeat an id are predicted each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of
from graphloom.llm.ngrams import counted

ORDERS, BITS, PER_LANGUAGE, SHARDS, EPOCHS = (1, 2, 3), 15, 800, 4, 3
STEP, SMOOTH, L1, L2 = 1.0, 1.0, 0.02, 0.02


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, counts = counted(text, ORDERS, BITS)
    values = (1.0 + np.log(counts)) * idf[places]
    norm = np.sqrt((values * values).sum())
    return places, values / norm if norm else values


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, how many hold each place) over every row of (text): one small vector a task, summed by place."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in source:
            for text in batch.column(0).to_pylist():
                held[counted(text, ORDERS, BITS)[0]] += 1
                rows += 1
        if rows:
            places = np.append(np.flatnonzero(held), -1)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(held[places[:-1]], rows))], names=["place", "docs"])

    sums = docs.select(text_of()).mapInArrow(batches, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs")).toPandas()
    found = np.zeros(1 << BITS, np.int64)
    real = sums[sums.place >= 0]
    found[real.place] = real.docs
    return int(sums.docs[sums.place < 0].sum()), found


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) after EPOCHS over the rows, by follow-the-regularised-leader with elastic-net penalties."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        over = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0.0)
        return -over / ((SMOOTH + np.sqrt(n[at])) / STEP + L2)

    for _ in range(EPOCHS):
        for places, values, truth in rows:
            at, x = np.append(places.astype(np.int64), 1 << BITS), np.append(values, 1.0)
            w = current(at)
            error = _softmax(x @ w)
            error[truth] -= 1.0
            g = x[:, None] * error[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / STEP * w
            n[at] = more
    w = current(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def fit(docs: DataFrame) -> Model:
    """From documents (doc_id, text, lang); pass only the rows that may be learned from."""
    known = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    size = 1 << BITS
    if len(languages) < 2:
        return Model(languages, np.zeros(size), np.zeros((size, len(languages))), np.zeros(len(languages)), 1.0)
    total, frequency = document_frequencies(known)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 0.1
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    most = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(1e6 * PER_LANGUAGE / n) + 1)))
    sample = known.where(draw < F.element_at(most, F.col("lang"))).withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(10 * SHARDS)))
    shared = docs.sparkSession.sparkContext.broadcast((languages, idf))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        names, scale = shared.value
        group = group.sort_values(["order", "doc_id"])
        w, b = follow_the_leader([(*_vector(t, scale), names.index(v)) for t, v in zip(group.text, group.lang)], len(names))
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"place": [*used.tolist(), -1], "w": [*w[used].tolist(), b.tolist()]})

    learn = sample.where(F.col("draw") >= SHARDS).withColumn("shard", F.pmod("draw", F.lit(SHARDS))).withColumn("order", F.xxhash64("doc_id", F.lit("order")))
    parts = learn.groupBy("shard").applyInPandas(train, "place long, w array<double>").toPandas()
    weights, bias = np.zeros((size, len(languages))), np.zeros(len(languages))
    shards = max(1, int((parts.place < 0).sum()))
    for place, w in zip(parts.place, parts.w):
        if place < 0:
            bias += np.asarray(w) / shards
        else:
            weights[place] += np.asarray(w) / shards
    model = Model(languages, idf, weights, bias, 1.0)
    held = _logits(sample.where(F.col("draw") < SHARDS).select(F.lit(None).cast("long"), "text", "lang"), model).toPandas()
    if len(held):
        z = np.array(held.z.tolist())
        truth = np.array([languages.index(v) for v in held.lang])
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 10, 60)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in source:
            out = []
            for text in batch.column(1).to_pylist():
                places, values = _vector(text, m.idf)
                out.append((values @ m.weights[places] + m.bias).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.list_(pa.float64()))], names=["lang", "z"])

    return rows.mapInArrow(batches, "lang string, z array<double>")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in source:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                if not m.languages or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                places, values = _vector(text, m.idf)
                chance = _softmax((values @ m.weights[places] + m.bias) / m.temperature)
                names.append(m.languages[int(chance.argmax())])
                scores.append(float(chance.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, "doc_id long, lang_pred string, score double")
