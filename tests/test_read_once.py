"""Queries that use rows several times read them written, not computed anew for each use."""

import duckdb

from sentrella.operators import correlate, reads
from sentrella.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_appends_read_the_same_written_events(spark, monkeypatch):
    seen, write = [], reads.write_events
    monkeypatch.setattr(reads, "write_events", lambda e, path: (seen.append(plan(e)), write(e, path)))
    assert registry.QUERIES["snk_append"](spark, SF).count() == 1
    assert len(seen) == 2 and not any("MapInArrow" in p for p in seen)


def test_findings_read_the_events_once(spark):
    got = registry.QUERIES["qry_findings"](spark, SF)
    assert plan(got).count("Relation [event_id") <= 5
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = db.execute(registry.SQL["qry_findings"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_trailing_runs_share_the_records(spark, monkeypatch):
    """What a record is grouped by is worked out before the runs that see it multiply it."""
    seen, write = [], correlate.written
    monkeypatch.setattr(correlate, "written", lambda df, name: (seen.append((name, df)), write(df, name))[1])
    got = registry.QUERIES["t3_trailing"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert [n for n, _ in seen] == ["t3-records"] and seen[0][1].count() == events and "prompt" not in seen[0][1].columns
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = db.execute(registry.SQL["t3_trailing"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
