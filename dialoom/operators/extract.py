"""Structured content out of completion, prompt and response-log text."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.args import json_object
from dialoom.functions.once import compute_once
from dialoom.functions.text import strip_ws

BARE_JSON = r"(\{[\S \t]*?\})"  # fixed value: a one-line object in free text
ENTITY_ID = r"(\b\w+\.\w+)(?=\s'|\s=)"  # fixed value: an id before a quoted name or a state
SERVICE_CALL = r"\b(\w+\.\w+)\([^)]*\)"  # fixed value: a service with its parameters
# fixed value: a dotted host name with a top level of two letters or more
HOST_NAME = r"^[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?)*\.[a-z]{2,}$"
HEXTETS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4}){0,7}"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def extract_fenced_calls(df: DataFrame, keys, text="text", tag="tool", bare=False) -> DataFrame:
    """One row per non-blank line of every fenced block (or bare one-line object): call text and validity."""
    pattern = BARE_JSON if bare else r"(?s)\Q```" + tag + r"\E\n(.*?)```"
    blocks = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("block_pos", "_block"))
    lines = blocks.select(*keys, "block_pos", F.posexplode(F.split("_block", "\n")).alias("line_pos", "raw_call"))
    return lines.filter(F.col("raw_call") != "").withColumn("valid", json_object(F.col("raw_call")).isNotNull())


def extract_prompt_entities(df: DataFrame, text="prompt") -> DataFrame:
    """Add `entity_ids` and `service_names` found in a prompt."""
    return df.withColumns({"entity_ids": F.regexp_extract_all(F.col(text), F.lit(ENTITY_ID), F.lit(1)),
                           "service_names": F.regexp_extract_all(F.col(text), F.lit(SERVICE_CALL), F.lit(1))})


CHAT = ("struct<object:string,choices:array<struct<text:string,finish_reason:string,message:struct<content:string>,"
        "delta:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>>")
RESPONSES = ("struct<object:string,id:string,status:string,error:struct<message:string>,output:array<struct<type:string,"
             "content:array<struct<type:string,text:string,refusal:string>>>>>")
LOCAL = "struct<message:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"


def _message_text(payload: Column, path: str, plain: Column) -> Column:
    """The text at `path`: as it is, or the texts of a list of strings and {text} items joined."""
    value = F.try_variant_get(payload, path, "variant")
    item = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")), F.lit(""))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(F.transform(value.try_cast("array<variant>"), item), "")).otherwise(plain)


def extract_provider_responses(df: DataFrame, body="body", provider="provider") -> DataFrame:
    """Add content, tool_calls (JSON), error and unfinished for chat, responses and local payloads."""
    keys = F.json_object_keys(F.col(body))
    df = compute_once(df, _c=F.from_json(body, CHAT), _r=F.from_json(body, RESPONSES), _l=F.from_json(body, LOCAL), _k=keys, _v=F.try_parse_json(body))
    kind = F.col(provider)
    choice = F.try_element_at("_c.choices", F.lit(1))
    no_choice = F.coalesce(F.size("_c.choices"), F.lit(0)) < 1
    whole, chunk = F.col("_c.object") == "chat.completion", F.col("_c.object") == "chat.completion.chunk"
    chat_text = F.when(whole, _message_text(F.col("_v"), "$.choices[0].message.content", choice["message"]["content"])).when(chunk, F.coalesce(choice["delta"]["content"], F.lit(""))).otherwise(choice["text"])
    calls = F.when(chunk, F.to_json(F.transform(choice["delta"]["tool_calls"], lambda c: c["function"])))
    output = F.try_element_at("_r.output", F.lit(1))
    item = F.try_element_at(output["content"], F.lit(1))
    needed = F.array(*[F.lit(x) for x in ("object", "output", "status", "id")])
    missing = F.array_except(needed, F.col("_k"))
    r_error = (F.when(F.size(missing) > 0, F.concat(F.lit("Response JSON is missing required keys: "), F.array_join(missing, ", ")))
               .when(F.col("_r.object") != "response", F.concat(F.lit("Response JSON object is not 'response', got "), "_r.object"))
               .when(F.col("_r.error").isNotNull(), F.coalesce(F.concat(F.lit("Response JSON error: "), "_r.error.message"),
                                                               F.lit("Response JSON error is missing 'message' key")))
               .when(output["type"] != "message", F.concat(F.lit("Response output type is not 'message', got "), output["type"]))
               .when(~item["type"].isin("refusal", "output_text"), F.concat(F.lit("Response output content type is not expected, got "), item["type"])))
    r_text = F.when(item["type"] == "refusal", item["refusal"]).when(item["type"] == "output_text", item["text"])
    chat, resp, local = kind == "chat", kind == "responses", kind == "local"
    return df.withColumns({
        "error": F.when(chat & no_choice, "missing or empty 'choices'").when(resp, r_error),
        "content": F.when(chat & ~no_choice, chat_text).when(resp & r_error.isNull(), r_text).when(local, _message_text(F.col("_v"), "$.message.content", F.col("_l.message.content"))),
        "tool_calls": F.when(chat & ~no_choice, calls).when(local & (F.size("_l.message.tool_calls") > 0), F.to_json("_l.message.tool_calls")),
        "unfinished": F.coalesce(F.when(chat, choice["finish_reason"].isin("length", "content_filter"))
                                 .when(resp & r_error.isNull(), F.col("_r.status") != "completed"), F.lit(False)),
    }).drop("_c", "_r", "_l", "_k", "_v")


def parse_sse_lines(lines: DataFrame, stream="stream_id", pos="line_no", line="line"):
    """(chunks, failures) of event-stream lines; a stream ends at its first [DONE] or error line."""
    text = strip_ws(F.col(line))
    df = lines.withColumns({"_text": text, "_error": text.startswith("error: ")})
    df = df.withColumn("chunk", F.when(F.col("_text").startswith("data: "), F.substring("_text", 7, 1 << 30)).otherwise(F.col("_text")))
    ends = df.groupBy(stream).agg(F.min(F.when(F.col("_error") | F.col("chunk").contains("[DONE]"), F.col(pos))).alias("_end"))
    live = df.join(ends, stream)
    chunks = live.filter((F.col("_end").isNull() | (F.col(pos) < F.col("_end"))) & (strip_ws(F.col("chunk")) != ""))
    failures = live.filter(F.col("_error") & (F.col(pos) == F.col("_end")))
    return chunks.select(stream, pos, "chunk"), failures.select(stream, pos, F.concat(F.lit("Error from server: "), "_text").alias("error"))


def extract_structured_output(df: DataFrame, validated: Column, method="method", text="raw_text", args="tool_args") -> DataFrame:
    """Add data and error: raw text, parsed JSON, or the first call's arguments.

    `validated` holds the schema errors of the call's arguments, NULL when there are none.
    """
    as_json = F.try_parse_json(F.col(text))
    kind = F.col(method)
    return df.withColumns({
        "data": F.when(kind == "none", F.col(text)).when(kind == "structure", F.to_json(as_json))
                .when((kind == "tool") & validated.isNull(), F.col(args)),
        "error": F.when((kind == "structure") & as_json.isNull(), fixed.BAD_JSON_TEXT)
                .when((kind == "tool") & F.col(args).isNull(), fixed.NO_TOOL_CALL_TEXT)
                .when(kind == "tool", F.concat(F.lit(fixed.SCHEMA_ERRORS_TEXT), validated))})


def is_ipv6(host: Column) -> Column:
    """Whether a lower-case text is an IPv6 address, with a zone after % or an IPv4 address as its end allowed."""
    zone = F.split(host, "%", -1)
    address = F.regexp_replace(F.get(zone, F.lit(0)), ":" + IPV4.strip("^$") + r"\z", ":0:0")
    halves = F.split(address, "::", -1)
    full = (F.size(halves) == 1) & F.regexp_like(address, F.lit(rf"\A{HEXTETS}\z")) & (F.size(F.split(address, ":")) == 8)
    # one :: stands for at least one group; a third colon stays with a half, which then doesn't match
    groups = F.filter(F.flatten(F.transform(halves, lambda x: F.split(x, ":"))), lambda x: x != "")
    short = (F.size(halves) == 2) & F.forall(halves, lambda x: (x == "") | F.regexp_like(x, F.lit(rf"\A{HEXTETS}\z"))) & (F.size(groups) <= 7)
    zoned = (F.size(zone) == 1) | ((F.size(zone) == 2) & (F.get(zone, F.lit(1)) != ""))
    return (full | short) & zoned & ~F.contains(host, F.lit("/"))


def flag_valid_hosts(df: DataFrame, host="host") -> DataFrame:
    """Add `valid_host`, by expressions on the row alone."""
    h = F.lower(strip_ws(F.coalesce(F.col(host), F.lit(""))))
    df = compute_once(df, _h=h)
    plain = (F.col("_h") == "localhost") | F.regexp_like("_h", F.lit(IPV4)) | F.regexp_like("_h", F.lit(HOST_NAME))
    return df.withColumn("valid_host", F.coalesce(F.when(F.contains("_h", F.lit(":")), is_ipv6(F.col("_h"))).otherwise(plain), F.lit(False))).drop("_h")


def host_of(url: Column) -> Column:
    """Host of a URL, with the brackets of an IPv6 host removed."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?\[?([^\]/?#]*?)\]?(?::\d+)?(?:[/?#]|$)", 1)
