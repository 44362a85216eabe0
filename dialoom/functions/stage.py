"""Stage tables: results written once and read by several later steps."""
import functools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="dialoom-")


def stage_dir(spark: SparkSession) -> str:
    """A new folder inside the shared folder that spark.checkpoint.dir names.

    Where none is named, a session on one machine (master local[...]) gets a temporary folder; on a
    cluster that is an error, because no other machine would see it. The folder is deleted when the
    session's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/dialoom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def _without_shuffle_files(spark: SparkSession):
    """Shuffle files of the writes inside are deleted as soon as each is done, not whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to shared storage and read it back, so that lineage ends here.

    Losing an executor afterwards costs a re-read, not a recomputation. Nothing asks for the shuffle files of the write again, so they go at once.
    """
    spark = df.sparkSession
    path = stage_dir(spark)
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
