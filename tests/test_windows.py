"""Windows over event times against their SQL: in a zone that changes its clocks, with and without a zone in the column, and without a time."""

from __future__ import annotations

import duckdb
import pytest

from graphloom.plans import registry

registry.load()
TIMES = "'2024-03-10 01:40:00', '2024-03-10 02:10:00.000001', '2024-03-10 02:50:00', '2024-03-10 03:10:00', '2024-11-03 00:59:59.999499', '2024-11-03 01:00:00', '2024-11-03 02:30:00', '1969-12-31 23:10:00', NULL, NULL"


def test_hours_of_whole_milliseconds(spark, tmp_path):
    """The SQL's hour is that of the rounded millisecond; a sliding window holds what lies in it, to the microsecond."""
    con = duckdb.connect()
    times = "'2024-11-03 00:59:59.999500', '2024-11-03 00:59:59.999499', '1969-12-31 22:59:59.999500', '1969-12-31 22:59:59.999501', '1969-12-31 23:00:00.0004'"
    con.execute(f"COPY (SELECT CAST(unnest([{times}]) AS TIMESTAMP) AS ts, 'a' AS event_type, 1.0 AS value) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = registry.QUERIES["tumbling_windows"](spark, str(tmp_path)).collect()
    assert sorted((str(r.start), r.n) for r in found) == sorted((str(s), n) for s, _, n in con.sql(registry.ORACLES["tumbling_windows"]).fetchall())
    slid = registry.QUERIES["sliding_windows"](spark, str(tmp_path)).where("start >= '2024-01-01'").collect()
    assert sorted((str(r.start), r.n) for r in slid) == [("2024-11-03 00:00:00", 2), ("2024-11-03 00:30:00", 2)]


@pytest.mark.parametrize("name", ["tumbling_windows", "sliding_windows", "session_windows"])
@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
def test_windows_do_not_follow_the_zone(spark, tmp_path, name, kind):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"COPY (SELECT i AS event_id, CAST(t AS {kind}) AS ts, i % 2 AS user_id, CASE WHEN i % 3 = 0 THEN 'a' ELSE 'b' END AS event_type, CAST(i AS DOUBLE) AS value FROM (SELECT unnest([{TIMES}]) AS t, unnest(generate_series(1, 10)) AS i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet'")
    answer = con.sql(registry.ORACLES[name])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = registry.QUERIES[name](spark, str(tmp_path))
        columns = sorted(found.columns)
        rows = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    places = [[d[0] for d in answer.description].index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in places) for r in answer.fetchall())
