"""The whole-graph seed check sees edges: ends that are not there are found, in the plan as in its SQL."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from graphloom.plans import registry

FROM = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def test_missing_ends_are_found(spark, tmp_path):
    registry.load()
    db = duckdb.connect()
    for name in TABLES:
        rows = spark.read.parquet(f"{FROM}/{name}.parquet")
        if name == "nation":
            rows = rows.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, 99).otherwise(F.col("n_regionkey")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = {tuple(r) for r in registry.QUERIES["graph_seed_problems"](spark, str(tmp_path)).collect()}
    assert [s for s, p in found if p == "missing end"] == ["nation:3 LOCATED_IN region:99"]
    assert found == set(db.execute(registry.ORACLES["graph_seed_problems"]).fetchall())
