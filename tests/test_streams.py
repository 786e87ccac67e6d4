"""Streams against their batch forms, with stops and restarts; sinks that are written twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconq.operators import telemetry
from beaconq.session import shared_path
from beaconq.streaming import replay, sinks, state, ttl

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def added(rows, path, step):
    rows.coalesce(1).write.parquet(f"{path}/step={step}")


@pytest.fixture
def place(spark):
    return shared_path(spark, "stream-test")


def calls(spark, rows):
    return spark.createDataFrame([(c, at(s)) for c, s in rows], "client long, ts timestamp")


def test_rate_limit_goes_on_after_a_restart(spark, place):
    first, then = [(1, s) for s in range(0, 50)], [(1, s) for s in range(50, 70)] + [(2, s) for s in range(60, 110)]
    late, end = [(1, 1)] * 30, [(None, 10_000)]
    build = lambda: state.over_limit_stream(replay.stream_of(spark, place, "client long, ts timestamp"), 40)
    added(calls(spark, first), place, 0)
    replay.started(build(), f"{place}-out").awaitTermination()
    for k, rows in enumerate((then, [(2, 400)], [(2, 401)], late, end), 1):
        added(calls(spark, rows), place, k)
    replay.started(build(), f"{place}-out").awaitTermination()
    got = {(r["client"], r["n"]) for r in spark.read.parquet(f"{place}-out/rows").filter("client IS NOT NULL").collect()}
    want = {(r["client"], r["n"]) for r in telemetry.over_limit(calls(spark, first + then), 40).collect()}
    assert got == want == {(1, 60), (2, 50)}  # the thirty late calls are not counted


def test_pages_are_new_once_across_a_restart(spark, place):
    schema = "url string, ts timestamp"
    rows = [[("a", 0), ("b", 1), ("a", 2)], [("a", 3600), ("c", 3601)], [("a", 200_000), ("d", 200_001)], [("a", 200_002)]]
    for k, part in enumerate(rows[:2]):
        added(spark.createDataFrame([(u, at(s)) for u, s in part], schema), place, k)
    build = lambda: state.new_pages(replay.stream_of(spark, place, schema))
    replay.started(build(), f"{place}-out").awaitTermination()
    for k, part in enumerate(rows[2:], 2):
        added(spark.createDataFrame([(u, at(s)) for u, s in part], schema), place, k)
    replay.started(build(), f"{place}-out").awaitTermination()
    got = sorted(r["url"] for r in spark.read.parquet(f"{place}-out/rows").collect())
    assert got in (["a", "a", "b", "c", "d"], ["a", "b", "c", "d"])  # after two days the page is new again once the state has expired


def test_frontier_is_drained_in_small_batches(spark, place):
    schema, seen = "digest string, url string", []
    added(spark.createDataFrame([(f"d{k % 9}", f"u{k % 9}") for k in range(30)], schema), place, 0)
    take = lambda rows, epoch: seen.append((epoch, sorted(r["digest"] for r in rows.collect())))
    state.drain(replay.stream_of(spark, place, schema), take, f"{place}-state", None, 4).awaitTermination()
    assert [len(d) for _, d in seen] == [4, 4, 1] and sorted(sum((d for _, d in seen), [])) == [f"d{k}" for k in range(9)]
    added(spark.createDataFrame([("e", "u")], schema), place, 1)
    state.drain(replay.stream_of(spark, place, schema), take, f"{place}-state", None, 4).awaitTermination()
    assert seen[3:] == [(1, ["e"])]


def put(key, seconds, order, value, until):
    return key, at(seconds), True, order, "", value, at(until), None


def ask(key, seconds, name):
    return key, at(seconds), False, None, None, None, None, name


def test_values_live_until_they_expire(spark, place):
    steps = [
        [put("a", 10, 1, "one", 100), put("a", 11, 3, "three", 60), put("a", 12, 2, "two", 900), put("b", 12, 1, "b", 1000), ask("a", 20, "a20"), ask("c", 20, "c20")],
        [ask("a", 70, "a70"), ask("b", 70, "b70")],
        [put("a", 500, 4, "four", 2000), ask("a", 501, "a501")],
        [ask("b", 1500, "b1500"), ask("a", 1500, "a1500")],
    ]
    build = lambda: ttl.answered(replay.stream_of(spark, place, ttl.ROWS))
    for k, rows in enumerate(steps[:2]):
        added(spark.createDataFrame(rows, ttl.ROWS), place, k)
    replay.started(build(), f"{place}-out").awaitTermination()
    for k, rows in enumerate(steps[2:], 2):
        added(spark.createDataFrame(rows, ttl.ROWS), place, k)
    replay.started(build(), f"{place}-out").awaitTermination()
    got = {r["request_id"]: r["value"] for r in spark.read.parquet(f"{place}-out/rows").collect()}
    assert got == {"a20": "three", "c20": None, "a70": None, "b70": "b", "a501": "four", "b1500": None, "a1500": "four"}


def cache_table(spark, place, merge=sinks.latest("key", "nth")):
    return sinks.Table(spark, place, "key", merge, "key string, nth long, value string", 8)


def values(table):
    return {r["key"]: (r["nth"], r["value"]) for r in table.rows().collect()}


def test_a_batch_counts_once(spark, place):
    table = cache_table(spark, place)
    rows = lambda *xs: spark.createDataFrame(xs, "key string, nth long, value string")
    assert values(table) == {}
    table.upsert(rows(("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")), 0)
    table.upsert(rows(("a", 9, "never")), 0)
    assert values(table) == {"a": (2, "z"), "b": (1, "y")} and table.rows().count() == 2
    table.upsert(rows(("c", 1, "c"), ("a", 1, "older")), 1)
    assert values(table) == {"a": (2, "z"), "b": (1, "y"), "c": (1, "c")}


def test_a_writer_that_failed_is_finished(spark, place, monkeypatch):
    table = cache_table(spark, place)
    rows = spark.createDataFrame([(f"k{i}", 1, "x") for i in range(20)], "key string, nth long, value string")
    table.upsert(rows, 0)
    # The second batch is staged and partly written, and then fails before it is recorded.
    real = sinks.Table._there
    more = spark.createDataFrame([(f"k{i}", 2, "y") for i in range(10, 30)], "key string, nth long, value string")

    def fails(self, path):
        if path.endswith("/_staged/1/_SUCCESS") and real(self, path):
            raise RuntimeError("lost")
        return real(self, path)

    monkeypatch.setattr(sinks.Table, "_there", fails)
    table.upsert(more, 1)
    fs, done = table._fs(f"{place}/_epochs/1")
    fs.delete(done, True)
    monkeypatch.undo()
    table.upsert(more, 1)
    got = values(table)
    assert len(got) == 30 == table.rows().count() and got["k9"] == (1, "x") and got["k10"] == (2, "y")
    with pytest.raises(ZeroDivisionError):
        cache_table(spark, place, lambda rows: 1 / 0).upsert(more, 2)
    assert len(values(table)) == 30
    table.upsert(spark.createDataFrame([("k0", 5, "z")], "key string, nth long, value string"), 2)
    assert values(table)["k0"] == (5, "z")


def test_added_rows_are_not_doubled(spark, place):
    write = sinks.appended(place)
    rows = spark.createDataFrame([("github", 1.0), ("arxiv", 2.0)], "engine_id string, duration_ms double")
    for epoch in (0, 1, 1):
        write(rows, epoch)
    assert spark.read.parquet(place).count() == 4


def test_coordinator_stream_equals_its_batch(spark, place):
    commands = [("k", 0, 1, "acquire", None, 50), ("k", 10, 2, "acquire", None, 50), ("k", 20, 3, "failure", "ENGINE_TIMEOUT", 100), ("k", 130, 4, "acquire", None, 10), ("j", 5, 5, "failure", "ENGINE_TIMEOUT", 30), ("j", 10, 6, "success", None, None)]
    frame = spark.createDataFrame(commands, state.COMMANDS)
    added(frame.filter("nth < 3"), place, 0)
    added(frame.filter("nth >= 3"), place, 1)
    build = state.coordinate_stream(replay.stream_of(spark, place, state.COMMANDS))
    replay.started(build, f"{place}-out").awaitTermination()
    got = sorted(map(str, spark.read.schema(state.SNAPSHOTS).parquet(f"{place}-out/rows").collect()))
    assert got == sorted(map(str, state.coordinate(frame).collect()))
