"""Pile files and in-context example files."""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.text import strip_ws
from dialoom.sources.pile_log import PileLog

# fixed values: columns of the pile files
PILES = {
    "device_names": "device_name description", "specific_actions": "service_name device_name phrase arguments",
    "templated_actions": "device_type service phrase multiplier", "status_requests": "device_type state phrase assistant_response",
    "failed_tool_calls": "service_name correct_device_name correct_friendly_name bad_device_name phrase error_result retry_prompt",
    "refusals": "reason_type service_name device_name friendly_name desired_state phrase response",
    "responses": "service response_starting response_confirmed persona short", "durations": "duration name",
    "system_prompts": "persona prompt", "hallucinated_service_names": "real_service hallucinated_service",
}
ICL_COLUMNS = ["type", "request", "tool", "response"]


def schema_of(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _languages(spark: SparkSession, root: str, name: str) -> dict:
    """Folder name -> path of every language that has the file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return {f.getPath().getParent().getName(): f.getPath().toString() for f in found}


def read_pile(spark: SparkSession, root: str, pile: str, columns=None, line_breaks=False) -> DataFrame:
    """All languages of a pile, `lang` being the name of the language's folder; every value is text.

    Columns are found by the names in each language's header: their order doesn't matter, further ones are
    ignored and missing ones are NULL. Values with line breaks need `line_breaks=True`, which reads each file in
    one task. Rows that were appended through the pile's log (`append_pile`) come after those of the files. No
    language with the file and no log: an empty table.
    """
    names = columns or PILES[pile].split(" ")
    parts = []
    for lang, path in sorted(_languages(spark, root, f"pile_of_{pile}.csv").items()):
        rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=line_breaks)
        have = {c.lstrip("\ufeff").strip(): c for c in rows.columns}
        parts.append(rows.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast("string").alias(c) for c in names], F.lit(lang).alias("lang")))
    log = PileLog(spark, root, pile)
    if log.version():
        rows = log.read()
        parts.append(rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in names], "lang"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema_of([*names, "lang"]))


def read_lines(spark: SparkSession, root: str, name: str, language="*") -> DataFrame:
    """One trimmed value per line, with its language."""
    found = [(lang, path) for lang, path in sorted(_languages(spark, root, name).items()) if language in ("*", lang)]
    parts = [spark.read.text(path).select(strip_ws(F.col("value")).alias("value"), F.lit(lang).alias("lang")) for lang, path in found]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema_of(["value", "lang"]))


def read_media_names(spark: SparkSession, root: str, name="pile_of_media_names.txt") -> DataFrame:
    """Media names are English in every language."""
    return read_lines(spark, root, name, "english")


def read_optional_pile(spark: SparkSession, root: str, pile: str) -> DataFrame:
    """An empty table where no language has the file."""
    return read_pile(spark, root, pile)


def read_icl_examples(spark: SparkSession, path: str) -> DataFrame:
    """In-context examples; the header must hold exactly the four columns, a byte order mark is ignored."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if sorted(rows.columns) != sorted(ICL_COLUMNS):
        raise ValueError(f"expected the columns {ICL_COLUMNS}, found {rows.columns}")
    return rows.select(*ICL_COLUMNS)


def append_pile(rows: DataFrame, root: str, pile: str, batch: str | None = None) -> int:
    """Append rows (with `lang`) to a pile as one commit that `read_pile` sees as a whole; an empty table commits nothing. See `PileLog.append`."""
    return PileLog(rows.sparkSession, root, pile).append(rows, batch)


def evolve_pile_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the wider schema; running it again changes nothing."""
    return old.unionByName(new, allowMissingColumns=True)
