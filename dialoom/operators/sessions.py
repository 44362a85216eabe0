"""Linking of answers that follow each other closely."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.scan import scan


def link_sessions(df: DataFrame, key: str, ts: str, limit_seconds: int, tie: str) -> DataFrame:
    """Add `linked` (the gap to the row before is below the limit) and a running `session` number.

    Rows are dealt out by ranges of (key, ts), so a key with very many rows, even on one day, is worked on by many tasks.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(df.schema[ts].dataType), F.col(ts))
    limit = limit_seconds * 1_000_000
    seen = scan(df, [key], [ts, tie], previous={"_before": micros}, gaps={"session": (micros, limit)})
    return seen.withColumn("linked", F.coalesce(micros - F.col("_before") < limit, F.lit(False))).drop("_before")
