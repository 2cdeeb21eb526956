"""The log-count ratios of the toxicity model count every labelled row, also those that the fitting sample leaves out."""

from __future__ import annotations

import numpy as np

from graphloom.llm import toxicity

from .conftest import SCHEMA, prose, row


def test_ratios_count_rows_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 10)
    monkeypatch.setattr(toxicity, "MOST_OTHER", 10)
    rows = [row(i, f"{prose(i, 10)} {'zork' if i % 3 == 0 else 'fine'} {prose(i + 1000, 10)}") for i in range(240)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = np.zeros((2, 1 << toxicity.BITS))
    for r in rows:
        held[int(r[0] % 3 == 0)][toxicity._places(r[1])] += 1
    want = toxicity.log_count_ratios(held[1], held[0], 80.0, 160.0)
    assert np.allclose(model.squares, want * want)
