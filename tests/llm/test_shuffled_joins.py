"""Joins of fingerprints are shuffled: small tables, too, are not gathered in the driver."""

from __future__ import annotations

from graphloom.llm import simhash


def test_links_broadcast_nothing(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = simhash.links(spark.range(1, 9).toDF("fp"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.a, r.b) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and "Broadcast" not in plan
    assert got == {(a, b) for a in range(1, 9) for b in range(a + 1, 9) if (a ^ b).bit_count() <= 3}
