"""Streams that a new checkpoint takes up from the tables of an earlier run."""
from datetime import datetime, timedelta

from dialoom.functions.stage import stage_dir
from dialoom.streaming import streams

ZERO = datetime(2024, 5, 1)
SCHEMA = "k string, ts timestamp"


def table(spark, rows):
    return spark.createDataFrame([(k, None if s is None else ZERO + timedelta(seconds=s)) for k, s in rows], SCHEMA)


def stream(spark, *tables):
    path = stage_dir(spark)
    for t in tables:
        t.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(df):
    return sorted(((r.k or "", int((r.refresh_at - ZERO).total_seconds()), r.kind) for r in df.collect()))


FIRST = [("a", 0), ("a", 5), ("b", 3), (None, 4), (None, 6), ("c", None)]
SECOND = [("a", 50), ("b", 8), ("d", 40), ("z", 400)]  # a's pending refresh is due at 30, between the two; the NULL key sees no further change


def test_throttle_goes_on_from_its_table(spark):
    streams.use_rocksdb(spark)
    first, second = table(spark, FIRST), table(spark, SECOND)
    whole = told(streams.run_to_table(streams.throttle_refresh(stream(spark, first, second), "k", "ts", 30)))
    one = streams.run_to_table(streams.throttle_refresh(stream(spark, first), "k", "ts", 30))
    state = streams.throttle_state(one, first, "k", "ts")
    assert sorted((r.k or "", r.pending) for r in state.collect()) == [("", True), ("a", True), ("b", False)]
    two = streams.run_to_table(streams.throttle_refresh(stream(spark, second), "k", "ts", 30, initial=state))
    assert told(one.unionByName(two)) == whole
    assert whole == [("", 4, "leading"), ("", 34, "trailing"), ("a", 0, "leading"), ("a", 30, "trailing"), ("a", 60, "trailing"),
                     ("b", 3, "leading"), ("b", 33, "trailing"), ("d", 40, "leading"), ("z", 400, "leading")]


def test_empty_initial_state(spark):
    streams.use_rocksdb(spark)
    none = table(spark, [])
    one = streams.run_to_table(streams.throttle_refresh(stream(spark, none), "k", "ts", 30))
    state = streams.throttle_state(one, none, "k", "ts")
    got = told(streams.run_to_table(streams.throttle_refresh(stream(spark, table(spark, [("a", 1)])), "k", "ts", 30, initial=state)))
    assert state.count() == 0 and got == [("a", 1, "leading")]


def test_latest_state_goes_on_from_its_table(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "entity_id string, state string, ts int")
    first, second = rows(("a", "on", 1), ("a", "off", 5), ("b", "on", 2), (None, "x", 1)), rows(("a", "late", 3), ("b", "off", 4), ("c", None, 9))
    run = lambda df, **k: streams.newest_version(streams.run_to_table(streams.latest_state_stream(stream(spark, df), **k), "update"))
    last = run(first)
    got = run(second, initial=stream(spark, last))
    assert sorted(((r.entity_id or "", r.state, r.last_update) for r in got.collect())) == [("", "x", 1), ("a", "off", 5), ("b", "off", 4), ("c", None, 9)]
