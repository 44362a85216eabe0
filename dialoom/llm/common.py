"""Small helpers of the document operators."""
import ctypes
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.stage import stage  # noqa: F401  (the operators stage through this module)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def byte_texts(texts: pa.Array) -> list:
    """UTF-8 bytes of each text; None stays."""
    return texts.cast(pa.binary()).to_pylist()


def text_key(doc_id: str, text: str) -> Column:
    """A 64-bit key shared by equal rows (same id, same text)."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def with_text(df: DataFrame, text: Column) -> DataFrame:
    """`df` with another text, and with n_chars brought up to date where it has that column."""
    df = df.withColumn("text", text)
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser; distinct inputs stay distinct."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy() -> None:
    """Give memory back to the system at a task's end: idle Python workers of one executor share its memory with busy ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession, rows=2000) -> None:
    """Let Arrow hand documents to Python in smaller batches; long texts make the default of 10,000 rows large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
