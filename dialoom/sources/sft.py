"""Training entries, evaluation reports and images."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SFT_SCHEMA = ("example_id string, text string, conversations array<struct<`from`:string,value:string>>, "
              "messages array<struct<role:string,content:variant,train_on_turn:boolean,"
              "tool_calls:array<struct<`function`:struct<name:string,arguments:string>>>>>, tools variant")
PIECE = "array<struct<type:string,text:string,name:string,response:struct<result:string>>>"


def write_sft_jsonl(entries: DataFrame, path: str, mode="errorifexists") -> None:
    """One JSON entry per line: example_id, and the message array as real JSON; with a column `tools` (a JSON array) also that."""
    tools = F.concat(F.lit(',"tools":'), F.coalesce("tools", F.lit("[]"))) if "tools" in entries.columns else F.lit("")
    line = F.concat(F.lit('{"example_id":'), F.to_json(F.col("example_id").cast("string").cast("variant")), F.lit(',"messages":'), F.col("messages"), tools, F.lit("}"))
    entries.select(line.alias("value")).write.mode(mode).text(path)


def read_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Message rows (example_id, pos, role, text) from entries holding text, conversations or messages.

    Entries without an id get one from their file and a hash of their content, so equal entries of one file share it
    only if they are equal in all fields.
    """
    rows = spark.read.schema(SFT_SCHEMA).json(path)
    own = F.concat_ws("#", F.element_at(F.split("_metadata.file_path", "/"), -1), F.sha2(F.to_json(F.struct("text", "conversations", "messages", "tools")), 256))
    rows = rows.withColumn("example_id", F.coalesce("example_id", own))
    pieces = lambda m: F.transform(m["content"].try_cast("array<variant>"), lambda i: F.try_variant_get(i, "$.text", "string"))
    flat = lambda m: F.coalesce(F.when(
        F.schema_of_variant(m["content"]).startswith("ARRAY"), F.array_join(pieces(m), "\n")).otherwise(m["content"].try_cast("string")), F.lit(""))
    shaped = (F.when(F.col("messages").isNotNull(), F.transform("messages", lambda m: F.struct(m["role"].alias("role"), flat(m).alias("text"))))
              .when(F.col("conversations").isNotNull(), F.transform("conversations", lambda m: F.struct(m["from"].alias("role"), m["value"].alias("text"))))
              .otherwise(F.array(F.struct(F.lit("text").alias("role"), F.col("text").alias("text")))))
    return rows.select("example_id", F.posexplode(shaped).alias("pos", "m")).select("example_id", "pos", "m.role", "m.text")


def write_eval_report(report: DataFrame, failures: DataFrame, path: str, mode="errorifexists") -> None:
    """Totals and failed examples as two JSON tables."""
    report.write.mode(mode).json(f"{path}/metrics")
    failures.write.mode(mode).json(f"{path}/failures")


def load_images_base64(spark: SparkSession, path: str, mime_types: DataFrame):
    """(images as base64 text, rejected files). mime_types(extension, mime_type) tells the kind by file ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).join(mime_types, "extension", "left")
    good = F.coalesce(F.col("mime_type").startswith("image/"), F.lit(False))
    return kind.filter(good).select("path", "mime_type", F.base64("content").alias("data")), \
        kind.filter(~good).select("path", "mime_type", F.lit("unsupported attachment type").alias("error"))
