"""Streams that are started: watermarks, late rows, a restart from the checkpoint, upserts and refreshes."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkboard.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(hour, minute=0, day=1):
    return datetime.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def source(spark, tmp_path):
    """Writes batches of events as files of one folder."""
    path = str(tmp_path / "events")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, add


def run(df, out, checkpoint, mode="append"):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_tumbling_windows_late_rows_and_restart(spark, source, tmp_path):
    path, add = source
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    add([(1, at(1), 1, "a", 2.0), (2, at(5), 1, "a", 3.0)])
    run(state.tumbling(state.read_events(spark, path), "1 hour", "1 hour"), out, mark)
    add([(3, at(12), 1, "a", 1.0)])
    run(state.tumbling(state.read_events(spark, path), "1 hour", "1 hour"), out, mark)  # from the checkpoint
    add([(4, at(1, 30), 1, "a", 100.0), (5, at(20), 1, "a", 1.0)])  # the first one is late: its window is closed
    run(state.tumbling(state.read_events(spark, path), "1 hour", "1 hour"), out, mark)
    got = {(r.start.hour, r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1, 2.0), (5, 1, 3.0), (12, 1, 1.0)}


def test_sessions_and_repeats_in_a_stream(spark, source, tmp_path):
    path, add = source
    add([(1, at(1), 1, "a", 1.0), (1, at(1), 1, "a", 1.0), (2, at(1, 20), 1, "a", 1.0), (3, at(3), 1, "a", 1.0), (4, at(23), 2, "a", 1.0)])
    run(state.without_repeats(state.read_events(spark, path)), str(tmp_path / "once"), str(tmp_path / "m1"))
    once = spark.read.parquet(str(tmp_path / "once"))
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 4]
    batch = {(r.user_id, r.start, r.n) for r in state.sessions(once).collect()}
    assert batch == {(1, at(1), 2), (1, at(3), 1), (2, at(23), 1)}
    add([(9, at(1, 0, 9), 9, "a", 1.0)])
    run(state.sessions(state.read_events(spark, path, 1), late="1 hour"), str(tmp_path / "s"), str(tmp_path / "m2"))
    assert {(r.user_id, r.start) for r in spark.read.parquet(str(tmp_path / "s")).collect()} >= {(1, at(1)), (1, at(3))}


def test_upserts_run_twice_and_refreshes(spark, source, tmp_path):
    path, add = source
    add([(1, at(1), 1, "a", 1.0), (2, at(2), 1, "b", 2.0)])
    add([(3, at(3), 1, "a", 5.0)])
    to, mark = str(tmp_path / "state"), str(tmp_path / "mark")
    write = state.upsert_into(to, "event_type", "ts")
    stream = state.read_events(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()
    stream.awaitTermination()
    want = {("a", 5.0), ("b", 2.0)}
    now = lambda: {(r.event_type, r.value) for r in state.latest(spark, to, "event_type", "ts").collect()}
    assert now() == want
    write(spark.createDataFrame([(3, at(3), 1, "a", 5.0)], SCHEMA), 1)  # the batch runs again
    assert now() == want
    refresh = state.overwrite_dataset(str(tmp_path / "data"))
    refresh(spark.range(3), 0)
    refresh(spark.range(5), 1)
    refresh(spark.range(5), 1)
    (tmp_path / "data" / "v=2").mkdir()  # a refresh that broke off
    assert state.newest_dataset(spark, str(tmp_path / "data")).count() == 5
    assert state.counters(spark.read.parquet(path)).where(F.col("event_type") == "a").first().n == 2
