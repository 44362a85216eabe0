"""Chat text in several model formats.

Rendering yields one piece of text per message; only the roles of the neighbouring messages
matter. Pieces are joined by `join_pieces` where one text per conversation is wanted.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.args import json_object, json_string, value_json
from dialoom.functions.scan import scan
from dialoom.functions.text import strip_ws
from dialoom.operators.messages import join_pieces

# fixed values: per style the texts that open and close a turn and that ask for an answer
TURNS = {
    "chatml": ("<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n"),
    "zephyr": ("<|", "|>\n", "<|endoftext|>\n", "<|assistant|>\n"),
    "zephyr_legacy": ("<|", "|>\n", "<|endoftext|>\n", "<|assistant|>"),
    "gemma3": ("<start_of_turn>", "\n", "<end_of_turn>\n", ""),
    "functiongemma": ("<start_of_turn>", "\n", "<end_of_turn>\n", "<start_of_turn>model\n"),
}
CALL_HELP = ("\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
             "<tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": "
             "<args-json-object>}\n</tool_call>")
DEVELOPER_TOOLS = "You are a model that can do function calling with the following functions"
DEVELOPER_NONE = "No tools have been provided. Only respond with answers that do not require tool usage."


def _role(style) -> Column:
    plain = F.when(F.col("role") == "tool_result", "tool").otherwise(F.col("role"))
    if style == "gemma3":
        return F.when(plain == "assistant", "model").when(plain == "system", "user").otherwise(plain)
    if style == "functiongemma":
        return F.when(plain == "assistant", "model").otherwise(plain)
    return plain


def format_argument(value: Column) -> Column:
    """A VARIANT in call notation: texts between escape marks, lists in brackets."""
    text = lambda v: F.concat(F.lit("<escape>"), v.try_cast("string"), F.lit("<escape>"))
    scalar = lambda v: F.when(F.schema_of_variant(v) == "STRING", text(v)).otherwise(value_json(v))
    listed = F.concat(F.lit("["), F.array_join(F.transform(value.try_cast("array<variant>"), scalar), ","), F.lit("]"))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(scalar(value))


def format_arguments(args: Column) -> Column:
    """JSON object text as key-sorted `k:v` pairs in call notation."""
    entries = F.sort_array(F.map_entries(F.transform_values(json_object(args), lambda k, v: format_argument(v))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")


def render_pieces(messages: DataFrame, style: str, tools_text: str | Column | None = None, key="conv_id", pos="pos",
                  fence="```tool") -> DataFrame:
    """Add `piece`, the text each message contributes; an opening tools text goes before the first.

    `tools_text` is one text for all conversations, or a column that says it per conversation (NULL: no tools). A column
    tool_results ARRAY<STRUCT<tool_name, tool_result>> holds several results of one tool message (the gemma styles).
    """
    start, mid, end, _ = TURNS[style]
    tools = tools_text if isinstance(tools_text, Column) else F.lit(tools_text).cast("string")
    has_tools = tools.isNotNull()
    calls_n = F.coalesce(F.size("tool_calls"), F.lit(0))
    tool_role = F.col("role") == "tool_result"
    state = F.struct(tool_role.alias("tool"), F.col("role").alias("role"))
    if style == "functiongemma":
        starts = messages.groupBy(key).agg(F.min(pos).alias("_start"))
        messages = messages.join(starts, key)
        state = F.struct(tool_role.alias("tool"), F.col("role").alias("role"), F.col("text").alias("text"), (F.col(pos) == F.col("_start")).alias("opens"))
    rows = scan(messages, [key], [pos], previous={"_prev": state}, following={"_next": F.struct(tool_role.alias("tool"))})
    first, last = F.col("_prev").isNull(), F.col("_next").isNull()
    after_tool, before_tool = F.coalesce(F.col("_prev.tool"), F.lit(False)), F.coalesce(F.col("_next.tool"), F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    role = _role(style)
    opening = F.concat(F.lit(start), role, F.lit(mid))
    calls = lambda f, sep="": F.array_join(F.transform(F.coalesce("tool_calls", F.expr(
        "cast(array() as array<struct<id:string,name:string,args:string>>)")), f), sep)
    system_first = first & (F.col("role") == "system")
    results = F.array(F.struct("tool_name", "tool_result"))
    if "tool_results" in messages.columns:
        results = F.when(F.size("tool_results") > 0, F.transform("tool_results", lambda r: F.struct(r["tool_name"].alias("tool_name"), r["tool_result"].alias("tool_result")))).otherwise(results)

    if style in ("chatml", "zephyr"):
        block = lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["args"], F.lit("}\n</tool_call>"))
        said = F.concat(opening, text, F.when((calls_n > 0) & (text != ""), "\n").otherwise(""), calls(block, "\n"), F.lit(end))
        tool = F.concat(F.when(after_tool, "").otherwise(F.lit(start + "user" + ("|>" if style == "zephyr" else ""))),
                        F.lit("\n<tool_response>\n"), F.col("tool_result"), F.lit("\n</tool_response>"),
                        F.when(before_tool, "").otherwise(end))
        head = start + "system" + mid
        body = F.when(system_first, F.when(has_tools, "").otherwise(F.concat(F.lit(head), text, F.lit("\n" + fixed.NO_TOOLS_TEXT + end))))
        lead = F.when(first & has_tools, F.concat(F.lit(head), F.when(system_first, F.concat(text, F.lit("\n\n"))).otherwise(""),
                                                  F.lit("Tools:\n"), tools, F.lit(CALL_HELP + end))).otherwise("")
        body = body.when(F.col("role").isin("user", "system"), F.concat(opening, text, F.lit(end))) \
            .when(F.col("role") == "assistant", said).when(tool_role, tool)
        piece = F.concat(lead, body)
    elif style == "zephyr_legacy":
        block = lambda c: F.concat(F.lit('{"name": "'), c["name"], F.lit('", "arguments": '), c["args"], F.lit("}\n"))
        fenced = F.when(calls_n > 0, F.concat(F.lit("\n" + fence + "\n"), calls(block), F.lit("```"))).otherwise(
            F.when(F.col("role") == "assistant", "\n").otherwise(""))
        services = F.when(F.col("role") == "system", F.concat(F.lit("\nServices:"), F.coalesce(tools, F.lit("")))).otherwise("")
        content = F.when(tool_role, F.col("tool_result")).otherwise(text)
        piece = F.concat(opening, content, services, fenced, F.lit(end))
    elif style == "gemma3":
        head = F.coalesce(F.concat(F.lit("Tools:\n"), tools), F.lit(fixed.NO_TOOLS_TEXT))
        block = lambda c: F.concat(F.lit('\n<tool_call>{"name": "'), c["name"], F.lit('", "arguments": '), c["args"], F.lit("}</tool_call>"))
        content = F.when(tool_role, F.concat(F.lit("<tool_result>"), F.array_join(F.transform(
            results, lambda r: strip_ws(r["tool_result"])), "</tool_result>\n<tool_result>"), F.lit("</tool_result>"))).otherwise(strip_ws(text))
        piece = F.concat(F.when(first, head).otherwise(""), opening, content, calls(block), F.lit(end))
    else:
        head = F.concat(F.lit(start + "developer" + mid), F.when(F.coalesce(tools, F.lit("")) != "", F.concat(F.lit(DEVELOPER_TOOLS), tools)).otherwise(DEVELOPER_NONE), F.lit(end))
        block = lambda c: F.concat(F.lit("<start_function_call>call:"), c["name"], F.lit("{"), format_arguments(c["args"]), F.lit("}<end_function_call>"))
        # a leading system text moves into the turn that follows it
        moved = F.when(F.col("_prev.role") == "system", F.concat(strip_ws(F.col("_prev.text")), F.lit("\n"))).otherwise("")
        second = (F.col("_prev.role") == "system") & F.col("_prev.opens")
        said = F.concat(F.when(after_tool, "").otherwise(opening), F.when(second, moved).otherwise(""), strip_ws(text), calls(block),
                        F.when((calls_n > 0) & last, "<start_function_response>").otherwise(""),
                        F.when(calls_n > 0, "").otherwise(end))
        response = F.array_join(F.transform(results, lambda r: F.concat(
            F.lit("<start_function_response>response:"), F.trim(r["tool_name"]), F.lit("{"), format_arguments(r["tool_result"]), F.lit("}<end_function_response>"))), "")
        piece = F.concat(F.when(first, head).otherwise(""),
                         F.when(system_first, "").when(tool_role, response).otherwise(said))
    return rows.withColumn("piece", piece).drop("_prev", "_next", "_first", "_last", "_start")


def render_chat(messages: DataFrame, style: str, tools_text=None, generation_prompt=False, key="conv_id", pos="pos",
                fence="```tool") -> DataFrame:
    """One text per conversation."""
    pieces = render_pieces(messages, style, tools_text, key, pos, fence)
    out = join_pieces(pieces, [key], pos, "piece")
    if generation_prompt and TURNS[style][3]:
        ends = messages.groupBy(key).agg(F.max_by(F.col("role") == "tool_result", pos).alias("_tool"))
        asks = F.lit(style != "functiongemma") | ~F.col("_tool")
        out = out.join(ends, key).withColumn("text", F.when(asks, F.concat(
            "text", F.lit(TURNS[style][3]))).otherwise(F.col("text"))).drop("_tool")
    return out


def format_tools(tools: DataFrame, key="tool") -> DataFrame:
    """Four renderings per tool from a parameter table (one row per tool and parameter).

    `minimal` name(a,b); `listed` - name(a, b): description; `schema` a function JSON and `input_schema` a JSON with
    name, description and input_schema, both with the parameters sorted by position. The columns param_description,
    minimum, maximum and item_type add to a parameter's schema where they are present and not NULL.
    """
    more = [c for c in ("param_description", "minimum", "maximum", "item_type") if c in tools.columns]
    got = tools.groupBy(key).agg(F.first("description").alias("description"), F.sort_array(F.collect_list(F.struct("param_pos", "param", "type", "required", *more))).alias("ps"))
    names = F.transform("ps", lambda p: p["param"])

    def parameter(p):
        fields = [F.concat(F.lit('"type":'), json_string(p["type"]))]
        if "param_description" in more:
            fields.append(F.concat(F.lit('"description":'), json_string(p["param_description"])))
        fields += [F.concat(F.lit(f'"{c}":'), p[c].cast("string")) for c in ("minimum", "maximum") if c in more]
        if "item_type" in more:
            fields.append(F.concat(F.lit('"items":{"type":'), json_string(p["item_type"]), F.lit("}")))
        return F.concat(json_string(p["param"]), F.lit(":{"), F.concat_ws(",", *fields), F.lit("}"))

    req = F.transform(F.filter("ps", lambda p: p["required"]), lambda p: json_string(p["param"]))
    shape = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(F.transform("ps", parameter), ","), F.lit('},"required":['), F.array_join(req, ","), F.lit("]}"))
    head = F.concat(F.lit('{"name":'), json_string(F.col(key)), F.lit(',"description":'), json_string(F.col("description")))
    return got.select(key, F.concat(F.col(key), F.lit("("), F.array_join(names, ","), F.lit(")")).alias("minimal"),
                      F.concat(F.lit("- "), F.col(key), F.lit("("), F.array_join(names, ", "), F.lit("): "), "description").alias("listed"),
                      F.concat(F.lit('{"type":"function","function":'), head, F.lit(',"parameters":'), shape, F.lit("}}")).alias("schema"),
                      F.concat(head, F.lit(',"input_schema":'), shape, F.lit("}")).alias("input_schema"))


def function_declarations(tools: DataFrame, key="tool") -> DataFrame:
    """Per tool its declaration in call notation, parameters sorted by name."""
    esc = lambda c: F.concat(F.lit("<escape>"), c, F.lit("<escape>"))
    got = tools.groupBy(key).agg(F.first("description").alias("description"), F.sort_array(F.collect_list(F.struct(
        "param", "param_description", "type", "required", "param_pos"))).alias("ps"))
    props = F.transform("ps", lambda p: F.concat(
        p["param"], F.lit(":{description:"), esc(p["param_description"]),
        F.when(p["type"] == "array", ",items:{type:<escape>STRING<escape>}").otherwise(""),
        F.lit(",type:"), esc(F.upper(p["type"])), F.lit("}")))
    needed = F.sort_array(F.transform(F.filter("ps", lambda p: p["required"]), lambda p: F.struct(p["param_pos"].alias("o"), p["param"].alias("n"))))
    req = F.array_join(F.transform(needed, lambda p: esc(p["n"])), ",")
    return got.select(key, F.concat(
        F.lit("<start_function_declaration>declaration:"), F.col(key), F.lit("{description:"), esc(F.col("description")),
        F.lit(",parameters:{properties:{"), F.array_join(props, ","), F.lit("},"),
        F.when(F.size(needed) > 0, F.concat(F.lit("required:["), req, F.lit("],"))).otherwise(""),
        F.lit("type:<escape>OBJECT<escape>}}<end_function_declaration>")).alias("declaration"))
