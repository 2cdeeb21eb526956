"""Every registered query against its SQL on the smallest tables; those without SQL have to give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.plans import registry

registry.load()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    if name not in registry.ORACLES:
        assert rows or name in ("fuzzy_names", "widest_sentence", "sentence_cooccurrence")
        return
    answer = duck.sql(registry.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in places) for r in answer.fetchall())
