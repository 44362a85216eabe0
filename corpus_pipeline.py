"""From raw documents to packed token sequences: language, common lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. run() writes each stage to the shared folder and reads it back for the next one.
"""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dialoom.llm.common import documents, small_batches, stage
from dialoom.llm.language_id import keep_identified
from dialoom.llm.line_dedup import LineStore, drop_common_lines
from dialoom.llm.packing import pack_documents
from dialoom.llm.simhash import drop_near_duplicates
from dialoom.llm.suffix_dedup import drop_repeated_passages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the filter learns from the documents' own language labels."""
    small_batches(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines found in ten documents or more."""
    small_batches(spark)
    return drop_common_lines(docs, LineStore.of(docs, min_docs=10, min_chars=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of strings of 100 bytes or more."""
    small_batches(spark)
    return drop_repeated_passages(docs, length=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids and their places in the sequences."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, window=2048, end_id=1, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": pipeline}
ORACLES = {}
