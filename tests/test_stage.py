"""Stage tables: a stage leaves its rows and no shuffle files."""
import time

from pyspark.sql import functions as F

from dialoom.functions import stage as S

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")


def test_a_stage_leaves_no_shuffle_files(spark):
    rows = spark.range(0, 20000, 1, 4).repartition(3, "id")
    was, before = spark.conf.get(CLEAN, None), shuffle_files(spark)
    staged = S.stage(rows.groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 15
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert staged.count() == 1000 and staged.agg(F.sum("count")).first()[0] == 20000
    assert S.stage(rows).count() == 20000 == S.stage(rows).count()  # the same plan again
    assert spark.conf.get(CLEAN, None) == was
