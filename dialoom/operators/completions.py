"""Tool calls out of completion text."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.args import canonical_args, json_object, json_string, VARIANT_MAP
from dialoom.functions.once import compute_once
from dialoom.functions.text import strip_ws

# fixed values: the call form some models write instead of JSON
CALL_FORM = r"call:(\w+)\{(.+)\}"
CALL_FORM_ARG = r"(\w+):<escape>(.+?)<escape>"


def _block(prefix: Column, suffix: Column) -> Column:
    return F.concat(F.lit(r"(?s)\Q"), prefix, F.lit(r"\E(.*?)\Q"), suffix, F.lit(r"\E"))


def extract_blocks(df: DataFrame, text="completion", think=None, tool=None, allow_unclosed=False) -> DataFrame:
    """Add `body` (text without thinking and call blocks) and `raw_calls` ARRAY<STRING>.

    `think` and `tool` are (prefix, suffix) columns and default to the usual markers. Calls are
    looked for before thinking is removed. With `allow_unclosed` a call left open at the end of
    the text counts as closed there.
    """
    think = think or (F.lit(fixed.THINK_PREFIX), F.lit(fixed.THINK_SUFFIX))
    tool = tool or (F.lit(fixed.TOOL_PREFIX), F.lit(fixed.TOOL_SUFFIX))
    whole = F.col(text)
    if allow_unclosed:
        # with every closed call taken out, an opening marker that is left has no end
        rest = F.regexp_replace(whole, _block(*tool), F.lit(""))
        whole = F.when(rest.contains(tool[0]), F.concat(whole, tool[1])).otherwise(whole)
    body = F.regexp_replace(whole, _block(*think), F.lit(""))
    return compute_once(df, raw_calls=F.regexp_extract_all(whole, _block(*tool), F.lit(1)),
                        body=F.regexp_replace(body, _block(*tool), F.lit("")))


def _last_wins(keys: Column, values: Column) -> Column:
    """Pairs to MAP<STRING,VARIANT>; of repeated keys the last value stays."""
    places = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: ~F.array_contains(
        F.slice(keys, i + 1, F.size(keys)), F.element_at(keys, i)))
    return F.map_from_entries(F.transform(places, lambda i: F.struct(
        F.element_at(keys, i), F.element_at(values, i).cast("variant"))))


def _fix_brightness(args: Column) -> Column:
    """A brightness in (0, 1] is a share of 255."""
    share = F.try_element_at(args, F.lit("brightness")).try_cast("double")
    fixed_value = F.floor(share * 255).cast("bigint").cast("variant")
    return F.when((share > 0) & (share <= 1), F.transform_values(
        args, lambda k, v: F.when(k == "brightness", fixed_value).otherwise(v))).otherwise(args)


def _fix_color(args: Column) -> Column:
    """A colour written as the text "(r, g, b)" becomes a list of integers."""
    value = F.try_element_at(args, F.lit("rgb_color"))
    text = value.try_cast("string")
    inner = F.substring(text, 2, F.length(text) - 2)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("int"))
    good = (F.schema_of_variant(value) == "STRING") & ~F.exists(numbers, lambda x: x.isNull())
    as_list = F.try_parse_json(F.concat(F.lit("["), F.concat_ws(",", numbers.cast("array<string>")), F.lit("]")))
    return F.when(good, F.transform_values(
        args, lambda k, v: F.when(k == "rgb_color", as_list).otherwise(v))).otherwise(args)


def normalize_tool_calls(df: DataFrame, raw="raw_call") -> DataFrame:
    """Add tool_name, args (canonical JSON), to_say and error for one raw call per row.

    Three forms are read: {"name", "arguments"}, the flat service form, and call:Name{...}.
    Rows that fit none keep NULL args and say why in `error`.
    """
    top = json_object(F.col(raw))
    df = compute_once(df, _top=top)
    keys = F.map_keys("_top")
    part = lambda k: F.try_element_at(F.col("_top"), F.lit(k))
    kind = lambda k: F.schema_of_variant(part(k))
    named = (F.size(keys) == 2) & F.array_contains(keys, "name") & F.array_contains(keys, "arguments") \
        & (kind("name") == "STRING") & (kind("arguments").startswith("OBJECT") | (kind("arguments") == "STRING"))
    allowed = fixed.SERVICE_STRING_ARGUMENTS + fixed.SERVICE_NUMBER_ARGUMENTS
    texts_ok = [part(k).isNull() | (kind(k) == "STRING") for k in fixed.SERVICE_STRING_ARGUMENTS]
    numbers_ok = [part(k).isNull() | part(k).try_cast("double").isNotNull() for k in fixed.SERVICE_NUMBER_ARGUMENTS]
    service = part("service").isNotNull() & part("target_device").isNotNull() \
        & (F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) == 0)
    for check in texts_ok + numbers_ok:
        service = service & check
    form = F.when(F.col("_top").isNotNull() & F.coalesce(named, F.lit(False)), "named") \
        .when(F.col("_top").isNotNull() & F.coalesce(service, F.lit(False)), "service") \
        .when(F.try_parse_json(F.col(raw)).isNotNull(), "other") \
        .when(F.regexp_like(F.col(raw), F.lit(CALL_FORM)), "call").otherwise("none")
    df = compute_once(df, _form=form)
    arg_text = strip_ws(part("arguments").try_cast("string"))
    inner = F.regexp_extract(F.col(raw), CALL_FORM, 2)
    call_args = _last_wins(F.regexp_extract_all(inner, F.lit(CALL_FORM_ARG), F.lit(1)),
                           F.regexp_extract_all(inner, F.lit(CALL_FORM_ARG), F.lit(2)))
    empty = F.create_map().cast(VARIANT_MAP)
    args = (F.when((F.col("_form") == "named") & (kind("arguments") == "STRING"),
                   F.when(arg_text == "", empty).otherwise(json_object(arg_text)))
            .when(F.col("_form") == "named", part("arguments").try_cast(VARIANT_MAP))
            .when(F.col("_form") == "service", F.col("_top"))
            .when(F.col("_form") == "call", call_args))
    name = (F.when(F.col("_form") == "named", part("name").try_cast("string"))
            .when(F.col("_form") == "service", F.lit(fixed.SERVICE_TOOL))
            .when(F.col("_form") == "call", F.regexp_extract(F.col(raw), CALL_FORM, 1)))
    df = compute_once(df, _args=args, tool_name=name)
    df = compute_once(df, _args=_fix_brightness(F.col("_args")))
    df = compute_once(df, _args=_fix_color(F.col("_args")))
    to_say = F.coalesce(F.try_element_at("_args", F.lit("to_say")).try_cast("string"), F.lit(""))
    error = (F.when(F.col(raw).isNull(), F.lit(None))
             .when(F.col("_form") == "none", fixed.ERR_NOT_JSON).when(F.col("_form") == "other", fixed.ERR_BAD_FORM)
             .when(F.col("_args").isNull(), fixed.ERR_BAD_ARGS))
    return compute_once(df, args=canonical_args(F.col("_args"), drop=("to_say",)),
                        to_say=F.when(F.col("_args").isNotNull(), to_say),
                        error=error).drop("_top", "_form", "_args")


def parse_completions(df: DataFrame, text="completion", has_api="has_api", think=None, tool=None,
                      allow_unclosed=False) -> DataFrame:
    """Add `response` (speech text) and `raw_calls`; without an API calls are ignored.

    The last call's `to_say` text is appended to the response.
    """
    blocks = extract_blocks(df, text, think, tool, allow_unclosed)
    allowed = F.col(has_api) & (F.size("raw_calls") > 0)
    blocks = blocks.withColumn("_last", F.when(allowed, F.element_at("raw_calls", -1)))
    said = normalize_tool_calls(blocks, "_last")
    return said.withColumns({
        "response": F.concat("body", F.coalesce("to_say", F.lit(""))),
        "raw_calls": F.when(F.col(has_api), F.col("raw_calls")).otherwise(F.array().cast("array<string>")),
    }).drop("_last", "body", "tool_name", "args", "to_say", "error")


def explode_calls(parsed: DataFrame, *keep) -> DataFrame:
    """One row per raw call with its position."""
    return parsed.select(*keep, F.posexplode("raw_calls").alias("call_pos", "raw_call"))


def dead_letter_calls(calls: DataFrame, keys, raw="raw_call"):
    """Split normalised calls into (good rows, message rows standing in for bad ones).

    A bad call becomes an assistant message with an empty call and a tool message with the error.
    """
    good = calls.filter(F.col("error").isNull())
    bad = calls.filter(F.col("error").isNotNull())
    named = F.col("error") == fixed.ERR_BAD_ARGS
    name = F.when(named, F.col("tool_name")).otherwise("unknown")
    given = F.when(named, json_object(F.col(raw))["arguments"].try_cast("string")).otherwise(F.col(raw))
    problem = F.concat(F.lit("Error occurred calling tool with args='"), given, F.lit("': "), F.col("error"))
    sides = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("assistant").alias("role"),
                 F.concat(F.lit('[{"args":{},"name":'), json_string(name), F.lit("}]")).alias("content")),
        F.struct(F.lit(1).alias("part"), F.lit("tool_result").alias("role"),
                 F.concat(F.lit('{"error":'), json_string(problem), F.lit("}")).alias("content")))
    messages = bad.select(*keys, name.alias("tool_name"), F.explode(sides).alias("m")) \
        .select(*keys, "m.part", "m.role", "tool_name", "m.content")
    return good, messages
