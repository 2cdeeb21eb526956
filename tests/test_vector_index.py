"""The index of inverted lists against all pairs: exact with its second round, by measured recall without."""

from __future__ import annotations

import numpy as np
import pytest

from graphloom.operators import vector, vector_index


def rows(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    """Twenty clusters, a third of all rows as copies of one, zero vectors, null vectors, ties."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 12))
    found = [(i, (centres[i % 20] + 0.15 * r.normal(size=12)).tolist()) for i in range(600)]
    found += [(1000 + i, centres[3].tolist()) for i in range(300)] + [(2000, [0.0] * 12), (2001, [0.0] * 12), (2002, None), (5, found[5][1])]
    return spark.createDataFrame(found, "id long, vector array<double>").repartition(3)


def test_second_round_equals_all_pairs(made):
    index = vector_index.build(made)
    asked = made.where("id % 37 = 0 OR id = 2000 OR id = 1003")
    exact = rows(vector.nearest(asked, made, 8))
    assert rows(vector_index.search(asked, index, 8, exact=True)) == exact
    assert rows(vector_index.search(asked, index, 8, probes=1, exact=True)) == exact


def test_recall_and_rows_read(made):
    index = vector_index.build(made)
    asked = made.where("id % 7 = 0 AND id < 600")
    want = {(q, i) for q, _, i, _ in rows(vector.nearest(asked, made, 10))}
    found = {(q, i) for q, _, i, _ in rows(vector_index.search(asked, index, 10))}
    assert len(want & found) >= 0.9 * len(want)
    assert index.probes < len(index.centroids) / 2  # clusters: a few lists hold the neighbours


def test_rows_that_lie_at_random_ask_for_more_lists(spark):
    r = np.random.default_rng(4)
    found = spark.createDataFrame([(i, r.normal(size=32).tolist()) for i in range(800)], "id long, vector array<double>")
    index = vector_index.build(found)
    asked = found.where("id % 10 = 0")
    want = {(q, i) for q, _, i, _ in rows(vector.nearest(asked, found, 10))}
    got = {(q, i) for q, _, i, _ in rows(vector_index.search(asked, index, 10))}
    assert len(want & got) >= 0.9 * len(want) and index.probes > len(index.centroids) / 4


def test_every_row_is_in_a_block_once(made):
    index = vector_index.build(made, lists=5)
    ids = sorted(i for r in index.blocks.collect() for i in r.ids)
    assert ids == sorted(r.id for r in made.collect() if r.vector is not None)


def test_empty_and_zero_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert vector_index.search(none, vector_index.build(none), 3).collect() == []
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, vector array<double>")
    assert [(q, i) for q, _, i, _ in rows(vector_index.search(zero, vector_index.build(zero), 2, exact=True))] == [(1, 1), (1, 2), (2, 1), (2, 2)]
