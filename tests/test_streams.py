from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import streams

SCHEMA = "id int, ts timestamp_ntz, session string, status string, tokens double"
START = datetime(2024, 1, 1, 12)


def event(i, minutes, session, status, tokens=1.0):
    return (i, START + timedelta(minutes=minutes), session, status, tokens)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds files to a folder; each becomes a micro-batch of its own."""

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return streams.stream_events(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)

    return add


def test_terminal_across_batches_and_restart(spark, tmp_path, feed):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(sdf):
        streams.stream_terminal(sdf, out, check, "session", "status", ["ts", "id"]).awaitTermination()
        return {r["id"] for r in spark.read.parquet(f"{out}/events").collect()}

    assert run(feed(event(1, 0, "a", "routing"), event(2, 1, "a", "complete"), event(3, 2, "a", "late"),
                    event(4, 0, "b", "routing"))) == {1, 2, 4}
    # the restart goes on after the first batch: session a stays closed, b closes now
    assert run(feed(event(5, 9, "a", "routing"), event(6, 3, "b", "failed"), event(7, 4, "b", "routing"),
                    event(8, 5, "c", "routing"))) == {1, 2, 4, 6, 8}


@pytest.mark.parametrize("batches", [1, 3])
def test_first_in_ttl_keeps_what_comes_a_day_later(spark, tmp_path, feed, batches):
    hours = [0, 10, 24, 25, 40, 49, 50, 75, 76]
    rows = [event(i, 60 * h, "q", "x") for i, h in enumerate(hours)]
    size = len(rows) // batches
    for at in range(0, len(rows), size):
        sdf = feed(*rows[at : at + size])
    first = streams.stream_first_in_ttl(sdf, "session", "ts", "24 hours")
    streams.stream_to_table(first, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    kept = sorted(hours[r["id"]] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [0, 25, 50, 75]


def test_first_in_ttl(spark, tmp_path, feed):
    sdf = feed(event(1, 0, "q", "x"), event(2, 30, "q", "x"), event(3, 31, "r", "x"))
    first = streams.stream_first_in_ttl(sdf, "session", "ts", "24 hours")
    streams.stream_to_table(first, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("session").count().filter("count > 1").count() == 0 and got.count() == 2


def test_append_resumes_without_repeats(spark, tmp_path, feed):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streams.stream_to_table(feed(event(1, 0, "a", "x")), out, check).awaitTermination()
    streams.stream_to_table(feed(event(2, 1, "a", "x")), out, check).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_sliding_windows(spark, tmp_path, feed):
    sdf = streams.stream_metrics(feed(event(1, 0, "a", "x"), event(2, 70, "a", "x")), "ts", "2 hours", "1 hour")
    streams.stream_snapshots(sdf, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r["window_start"].hour, r["n"]) for r in streams.last_snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {(11, 1), (12, 2), (13, 1)}


def test_sessions_over_two_batches(spark, tmp_path, feed):
    feed(event(1, 0, "a", "x"), event(2, 10, "a", "x"))
    sdf = feed(event(3, 35, "a", "x"), event(4, 120, "a", "x"), event(5, 0, "b", "x"))
    sessions = streams.stream_sessions(sdf, "ts", "session", "30 minutes", "1 hour", "tokens")
    streams.stream_snapshots(sessions, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r["session"], r["n"], r["total"]) for r in streams.last_snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 3, 3.0), ("a", 1, 1.0), ("b", 1, 1.0)}


def test_budget_alerts_in_update_mode(spark, tmp_path, feed):
    limits = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "provider string, daily_limit double")
    sdf = feed(event(1, 0, "a", "x", 9.5), event(2, 1, "b", "x", 9.4)).withColumnRenamed("session", "provider")
    alerts = streams.stream_budget_alerts(sdf, "ts", "provider", "tokens", limits)
    streams.stream_snapshots(alerts, str(tmp_path / "out"), str(tmp_path / "check"), "update").awaitTermination()
    assert [r["provider"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_latest_status_stream(spark, tmp_path, feed):
    feed(event(1, 0, "a", "routing"))
    sdf = feed(event(2, 1, "a", "cleaning"), event(3, 2, "a", "unheard"))
    status = streams.stream_latest_status(sdf, "session", "status", ["ts", "id"])
    streams.stream_snapshots(status, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    row = streams.last_snapshot(spark, str(tmp_path / "out")).select("session", "status", F.col("step")).first()
    assert tuple(row) == ("a", "unheard", 2)


def test_upserts_write_changed_keys_only(spark, tmp_path):
    """Three runs of one stream: keys that did not change are not written again, also over a compaction and a restart."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    want = {}

    def run(rows):
        spark.createDataFrame(rows, "k string, status string, at long").coalesce(1).write.mode("append").parquet(source)
        sdf = spark.readStream.schema("k string, status string, at long").parquet(source)
        latest = streams.stream_latest_status(sdf, "k", "status", ["at"])
        streams.stream_upserts(latest, out, checkpoint, "k", compact_every=2).awaitTermination()
        for k, status, at in rows:
            want[k] = max(want.get(k, (at, status)), (at, status))
        got = {r["k"]: r["status"] for r in streams.newest_rows(spark, out, "k").collect()}
        assert got == {k: v[1] for k, v in want.items()}

    run([("a", "routing", 1), ("b", "routing", 1), ("c", "routing", 1)])
    run([("b", "ingesting", 2)])
    run([("c", "complete", 3), ("c", "cleaning", 2), ("d", "routing", 3)])
    changes = spark.read.parquet(f"{out}/changes")
    assert sorted((r["batch"], r["k"]) for r in changes.collect()) == [(0, "a"), (0, "b"), (0, "c"), (1, "b"), (2, "c"), (2, "d")]
    assert [r["batch"] for r in spark.read.parquet(f"{out}/base").select("batch").distinct().collect()] == [1]
    again = streams.newest_rows(spark, out, "k", upto=1).collect()
    assert {r["k"]: r["status"] for r in again} == {"a": "routing", "b": "ingesting", "c": "routing"}


def test_ledger_is_compacted_and_forgets(spark, tmp_path, feed):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(*rows):
        streams.stream_terminal(
            feed(*rows), out, check, "session", "status", ["ts", "id"], remember="1 day", compact_every=2
        ).awaitTermination()
        return {r["id"] for r in spark.read.parquet(f"{out}/events").collect()}

    run(event(1, 0, "old", "complete"), event(2, 5, "open", "routing"))
    run(event(3, 60 * 48, "new", "complete"))  # compacted here: "old" ended two days before "new"
    base = spark.read.parquet(f"{out}/ledger/base")
    assert [(r["_session"], r["batch"]) for r in base.collect()] == [("new", 1)]
    got = run(event(4, 60 * 49, "new", "late"), event(5, 60 * 49, "open", "failed"), event(6, 60 * 50, "open", "late"))
    assert got == {1, 2, 3, 5}
    assert run(event(7, 60 * 51, "open", "late"), event(8, 60 * 51, "fresh", "routing")) == {1, 2, 3, 5, 8}


def test_equal_moments_are_told_apart_by_the_tie(spark, tmp_path, feed):
    sdf = feed(event(9, 0, "q", "x"), event(2, 0, "q", "x"), event(5, 0, "q", "x"))
    first = streams.stream_first_in_ttl(sdf, "session", "ts", "24 hours", "id")
    streams.stream_to_table(first, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_first_in_ttl_state_is_kept_by_bucket(spark, tmp_path):
    """Many keys, null and large ones among them, are a few groups of the state; each key is judged for itself, also in a later batch."""
    big = 2**60
    keys = [(None, None), (None, "x"), (big, None), (big, "x"), (big + 1, "x"), (big + 1, "y")] + [(i, "x") for i in range(40)]
    source, schema = str(tmp_path / "in"), "id long, k long, s string, ts timestamp_ntz"
    for hours in ([0, 10], [24, 30, 60]):
        rows = [(big + 100 * n + h, k, s, START + timedelta(hours=h)) for n, (k, s) in enumerate(keys) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    sdf = streams.stream_events(spark, source, schema, files_per_batch=1)
    first = streams.stream_first_in_ttl(sdf, ["k", "s"], "ts", "24 hours", buckets=4)
    query = streams.stream_to_table(first, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    kept = {(r["id"], r["k"], r["s"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept == {(big + 100 * n + h, k, s) for n, (k, s) in enumerate(keys) for h in (0, 30, 60)}
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 16
