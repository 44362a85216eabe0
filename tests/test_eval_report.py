"""The evaluation report scores its examples once."""
from pyspark.sql import functions as F

from dialoom.plans import extend, scoring


def test_examples_are_scored_once_for_both_tables(spark, sf_dir, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def counted(x):
        runs.add(1)
        return x

    whole = scoring.scored
    rows = whole(spark, sf_dir).count()
    monkeypatch.setattr(scoring, "scored", lambda *a: whole(*a).withColumn("possible", F.udf(counted, "bigint")("possible")))
    assert extend.s9_write_eval_report(spark, sf_dir).count() > 0
    assert runs.value == rows
