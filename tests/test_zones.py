"""Queries whose results must not depend on the session's time zone."""

import duckdb
import pytest


def test_log_counts_in_another_zone(spark, sf):
    from cuegrid.plans.reference_queries import t7
    from cuegrid.plans.registry import ORACLES

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    wanted = sorted(duck.execute(ORACLES["t7_stream_log_counts"]).fetchall())
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = sorted((r.minute, r.stage, r.evt, r.n) for r in t7(spark, sf).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == wanted


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
@pytest.mark.parametrize("name", ["t2_stream_loudness", "t3_stream_islands", "t7_stream_log_counts"])
def test_streams_in_another_zone(spark, sf, tmp_path, name, kind):
    """Times with a zone and without, through an hour that the session's zone leaves out."""
    from cuegrid.plans.registry import ORACLES, QUERIES

    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    at = "TIMESTAMP '2024-03-10 01:00:00' + to_seconds(event_id % 97 * 120 + event_id * 0.001 + CASE WHEN event_id % 97 = 96 THEN 200000 ELSE 0 END)"
    duck.execute(f"COPY (SELECT * REPLACE (CAST({at} AS {kind}) AS ts) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = duck.execute(ORACLES[name])
    columns = [x[0] for x in wanted.description]
    wanted = sorted(wanted.fetchall())
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(columns).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert wanted and found == wanted
