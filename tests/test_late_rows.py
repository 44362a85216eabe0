"""Session streams that keep their late rows: every row is in a session or kept as late."""
import json
from datetime import datetime, timedelta

import pandas as pd

from dialoom.functions.stage import stage_dir
from dialoom.streaming import streams

ZERO = datetime(2024, 5, 1)
SCHEMA = "k string, id bigint, ts timestamp"


def run(spark, batches, gap=600, delay="30 minutes"):
    """One run per batch over one checkpoint; each run sees one more batch of (key, id, minute)."""
    streams.use_rocksdb(spark)
    source, folder = stage_dir(spark), stage_dir(spark)
    got = None
    for rows in batches:
        made = [(k, i, None if m is None else ZERO + timedelta(minutes=m)) for k, i, m in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.session_stream_keeping_late(spark.readStream.schema(SCHEMA).parquet(source), "k", "ts", gap, delay)
        got = streams.run_to_table(stream, folder=folder)
    return got.toPandas()


def minutes(t):
    return None if pd.isna(t) else (t - ZERO).total_seconds() / 60


def test_rows_in_are_rows_out_over_three_batches(spark):
    got = run(spark, [
        [("a", 1, 0), ("a", 2, 20), ("b", 3, 5), ("b", 4, 60)],   # watermark 30 afterwards: a closes both, b its first
        [("a", 5, 10), ("b", 6, 68), ("b", 7, 50), ("c", 8, 45)],  # id 5 is late; 50 is ten minutes from 60: apart
        [("b", 9, 55), ("c", 10, None), ("a", 11, 200)],            # 55 joins 50 and 60
        [("d", 12, 400)],
    ])
    sessions = sorted((r.k, minutes(r.start), minutes(r.last_event), r.n) for r in got[got.kind == "session"].itertuples())
    assert sessions == [("a", 0, 0, 1), ("a", 20, 20, 1), ("a", 200, 200, 1), ("b", 5, 5, 1), ("b", 50, 68, 4), ("c", 45, 45, 1)]
    late = {json.loads(r.row)["id"]: (r.k, minutes(r.start), r.n) for r in got[got.kind == "late"].itertuples()}
    assert late == {5: ("a", 10, 1), 10: ("c", None, 1)}
    assert got.n.sum() == 12 - 1  # the last row's session is still open


def test_a_session_closes_when_the_watermark_reaches_its_end(spark):
    got = run(spark, [[("a", 1, 0)], [("z", 2, 40)]])  # watermark 10 = last + gap
    assert [(r.k, r.kind, r.n) for r in got.itertuples()] == [("a", "session", 1)]
    got = run(spark, [[("z", 1, 40)], [("a", 2, 0), ("a", 3, 0.5)]])  # 0 + gap is the watermark, 0.5 + gap beyond it
    assert [(r.k, r.kind, minutes(r.start)) for r in got.itertuples()] == [("a", "late", 0)]


def test_no_rows_and_one_long_key(spark):
    assert len(run(spark, [[]])) == 0
    many = [("a", i, i * 7919 % 20000 / 100) for i in range(20000)]  # one session in any order, in several Arrow batches
    got = run(spark, [many, [("z", 0, 10000)]])
    assert [(r.k, r.n, minutes(r.start), round(minutes(r.last_event), 6)) for r in got.itertuples()] == [("a", 20000, 0, 199.99)]
