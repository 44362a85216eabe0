"""Range-partitioned scans against plain windows, with groups over many partitions and batches."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions.scan import scan


@pytest.fixture
def many_parts(spark):
    """Small partitions and Arrow batches, so that groups cross both."""
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def by_windows(df):
    w = Window.partitionBy("k", "k2").orderBy("o")
    begins = F.coalesce((F.col("at") - F.lag("at").over(w) >= 3).cast("int"), F.lit(1))
    return df.withColumn("begins", begins).withColumns({"n": F.row_number().over(w).cast("bigint"), "total": F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                           "prev": F.lag("s").over(w), "next": F.lead("s").over(w), "before": F.lag(F.struct("s", "v")).over(w),
                           "stretch": F.sum("begins").over(w)}).drop("begins")


@pytest.mark.parametrize("shape", ["hot", "single", "tiny", "spread", "none"])
def test_scan_equals_windows(spark, many_parts, shape):
    r = random.Random(shape)
    keys = {"hot": ["a"] * 5 + ["b", "c", None], "single": ["a"], "tiny": ["a", "b"], "spread": [f"k{i}" for i in range(200)], "none": ["a"]}[shape]
    rows = [(r.choice(keys), r.choice([1, 1, 1, 2]) if shape != "single" else 1, i, r.choice([None, 1, 5, -3]), r.choice([None, f"s{i}"]), None if r.random() < 0.02 else 2 * i + r.choice([0, 0, 0, 9])) for i in range({"tiny": 3, "none": 0}.get(shape, 900))]
    df = spark.createDataFrame(rows, "k string, k2 int, o bigint, v int, s string, at bigint").repartition(5)
    got = scan(df, ["k", "k2"], ["o"], sums={"n": F.lit(1), "total": F.col("v")}, previous={"prev": F.col("s"), "before": F.struct("s", "v")}, following={"next": F.col("s")},
               gaps={"stretch": (F.col("at"), 3)})
    want = by_windows(df)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_group_uses_many_tasks(spark, many_parts):
    df = spark.range(20_000).select(F.lit("same key").alias("k"), F.col("id").alias("o"), F.concat(F.lit("a common start of all names "), "id").alias("name"))
    got = scan(df, ["k"], ["name"], sums={"place": F.lit(1)})
    assert got.agg(F.max("place"), F.count_distinct("place")).first() == (20_000, 20_000)
    assert len(got.inputFiles()) >= 10  # a staged file per task


def test_columns_that_are_replaced(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 8)], "k string, o int, n int")
    got = scan(df, ["k"], ["o"], sums={"n": F.col("n")}, previous={"k_before": F.col("k")})
    assert sorted(map(tuple, got.select("k", "o", "n", "k_before").collect())) == [("a", 1, 7, None), ("a", 2, 15, "a")]


def test_input_is_scanned_once(spark, sf_dir):
    """The staged result is all that a plan reads, and it has one exchange less than rows times passes: none of the input's."""
    from dialoom.plans import messages, snapshot, streams
    for query in (messages.w1_number_tool_calls, messages.x21_training_mask, snapshot.w5_order_by_recency, streams.w8_link_sessions):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "conversations.parquet" not in plan and plan.count("Relation") <= 2, query.__name__
