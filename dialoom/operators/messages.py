"""Conversation tables: numbering, trimming, replies, and API message formats.

A message row is (conv_id, pos, role, text, tool_calls ARRAY<STRUCT<id,name,args>>, tool_call_id,
tool_name, tool_result). `pos` orders a conversation; args and tool_result hold JSON text.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.args import json_string
from dialoom.functions.scan import scan


def join_pieces(df: DataFrame, keys, pos: str, piece: str, out="text", sep="") -> DataFrame:
    """Join pieces in order into one text per key.

    The text of a chat or home is one value, so its group is as large as its result. Where such a
    text would not fit a row, work on the ordered pieces instead; an oversize row fails the job.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(piece).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias(out))


def number_tool_calls(messages: DataFrame, key="conv_id", pos="pos") -> DataFrame:
    """One row per call; calls without an id get `call_N`, N running over the conversation.

    The counter also advances for calls that bring their own id.
    """
    calls = messages.select(key, pos, F.posexplode("tool_calls").alias("call_pos", "c"))
    n = scan(calls, [key], [pos, "call_pos"], sums={"n": F.lit(1)})
    return n.select(key, pos, "call_pos", F.coalesce(F.col("c.id"), F.concat(F.lit("call_"), F.col("n"))).alias("call_id"),
                    F.col("c.name").alias("tool_name"), F.col("c.args").alias("args"))


def trim_history(messages: DataFrame, n: int, key="conv_id", pos="pos") -> DataFrame:
    """Keep the first message (the system prompt) and the last 2*n others.

    Both picks are ranked with a limit, which Spark applies inside each input partition before it
    shuffles, so a very long conversation does not travel as a whole.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(pos))
    oldest = Window.partitionBy(key).orderBy(F.asc(pos))
    last = messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 2 * n)
    first = messages.withColumn("_rn", F.row_number().over(oldest)).filter(F.col("_rn") <= 1)
    rest = first.join(last.select(key, pos), [key, pos], "left_anti")
    return last.unionByName(rest.select(*last.columns)).drop("_rn")


def final_reply(messages: DataFrame, key="conv_id", pos="pos") -> DataFrame:
    """The last non-empty assistant text after the first message, or a fixed sentence."""
    starts = messages.groupBy(key).agg(F.min(pos).alias("_first"))
    said = (F.col("role") == "assistant") & (F.col("text") != "")
    two = F.struct(F.col(pos).alias("p"), F.col("text").alias("t"))
    # the last text wins unless it sits on the first message, in which case there is no other
    last = messages.groupBy(key).agg(F.max(F.when(said, two)).alias("_last"))
    joined = last.join(starts, key)
    ok = F.col("_last").isNotNull() & (F.col("_last.p") > F.col("_first"))
    return joined.select(key, F.when(ok, F.col("_last.t")).otherwise(fixed.NO_SPEECH_TEXT).alias("reply"))


def request_text(messages: DataFrame, which="last", key="conv_id", pos="pos") -> DataFrame:
    """The text of the last (or first) user message; without one, of the last message."""
    is_user = F.col("role") == "user"
    pick = F.max_by if which == "last" else F.min_by
    return messages.groupBy(key).agg(
        F.coalesce(pick("text", F.when(is_user, F.col(pos))), F.max_by("text", F.col(pos))).alias("request"))


def iteration_budget(messages: DataFrame, max_rounds: int, key="conv_id", pos="pos") -> DataFrame:
    """Rounds used per conversation: assistant messages up to the first one without a call.

    `error` is set when `max_rounds` rounds pass and the last of them still calls a tool. With a
    limit of 0 one round is made and calls in it are no error.
    """
    rounds = messages.filter(F.col("role") == "assistant")
    calling = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    stop = rounds.groupBy(key).agg(F.min(F.when(~calling, F.col(pos))).alias("_stop"))
    used = rounds.join(stop, key).groupBy(key).agg(
        F.count(F.when(F.col("_stop").isNull() | (F.col(pos) <= F.col("_stop")), F.lit(1))).alias("_n"),
        F.max(F.col("_stop").isNotNull()).alias("_stopped"))
    cap = max(1, max_rounds)
    over = (F.col("_n") > cap) | ((F.col("_n") == cap) & ~F.col("_stopped"))
    return used.select(key, F.least("_n", F.lit(cap)).cast("bigint").alias("rounds"),
                       F.when(over & F.lit(max_rounds > 0), fixed.OUT_OF_ATTEMPTS_TEXT).alias("error"))


def _calls(f) -> Column:
    return F.array_join(F.transform("tool_calls", f), ",")


def to_openai_messages(messages: DataFrame, args_as_str=True, result_as_str=True, keep_plain=True,
                       content_as_list=False) -> DataFrame:
    """Add `message`, the chat-completions JSON of each row.

    `keep_plain=False` leaves out assistant rows without calls. A column attachments ARRAY<STRUCT<mime_type, data>> adds
    the images (base64) of user messages, and a column `error` for rows with attachments of another kind.
    """
    attached = "attachments" in messages.columns
    pictures = F.filter("attachments", lambda a: a["mime_type"].startswith("image/")) if attached else None
    has_calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    text = json_string(F.coalesce("text", F.lit("")))
    args = (lambda c: json_string(c["args"])) if args_as_str else (lambda c: c["args"])
    call = lambda c: F.concat(F.lit('{"type":"function","id":'), json_string(F.coalesce(c["id"], F.lit(""))),
                              F.lit(',"function":{"arguments":'), args(c), F.lit(',"name":'), json_string(c["name"]), F.lit("}}"))
    shown = F.transform(pictures, lambda a: F.concat(F.lit(',{"type":"image_url","image_url":{"url":'), json_string(a["data"]), F.lit("}}"))) if attached else F.array(F.lit(""))
    user = F.concat(F.lit('[{"type":"text","text":'), text, F.lit("}"), F.coalesce(F.array_join(shown, ""), F.lit("")), F.lit("]")) if content_as_list else text
    images = F.lit("")
    if attached and not content_as_list:
        images = F.when(F.size(pictures) > 0, F.concat(F.lit(',"images":['), F.array_join(F.transform(pictures, lambda a: json_string(a["data"])), ","), F.lit("]"))).otherwise("")
    result = json_string(F.col("tool_result")) if result_as_str else F.concat(
        F.lit('{"name":'), json_string(F.col("tool_name")), F.lit(',"response":{"result":'), F.col("tool_result"), F.lit("}}"))
    message = (F.when(F.col("role") == "system", F.concat(F.lit('{"role":"system","content":'), text, F.lit("}")))
               .when(F.col("role") == "user", F.concat(F.lit('{"role":"user","content":'), user, images, F.lit("}")))
               .when((F.col("role") == "assistant") & has_calls, F.concat(
                   F.lit('{"role":"assistant","content":'), text, F.lit(',"tool_calls":['), _calls(call), F.lit("]}")))
               .when(F.col("role") == "assistant", F.concat(F.lit('{"role":"assistant","content":'), text, F.lit("}")))
               .when(F.col("role") == "tool_result", F.concat(
                   F.lit('{"role":"tool","content":'), result, F.lit(',"tool_call_id":'),
                   json_string(F.coalesce("tool_call_id", F.lit(""))), F.lit("}"))))
    rows = messages if keep_plain else messages.filter((F.col("role") != "assistant") | has_calls)
    if attached:
        refused = (F.col("role") == "user") & F.exists("attachments", lambda a: ~a["mime_type"].startswith("image/"))
        refused = F.coalesce(refused, F.lit(False))
        return rows.withColumns({"message": F.when(~refused, message), "error": F.when(refused, "unsupported attachment type")})
    return rows.withColumn("message", message)


def to_anthropic_messages(messages: DataFrame, result_as_str=True, key="conv_id", pos="pos"):
    """Return (system prompts per conversation, message rows with block content).

    The last system text wins. Tool results become user messages; rows without content go.
    """
    is_system = F.col("role") == "system"
    system = messages.groupBy(key).agg(
        F.coalesce(F.max_by("text", F.when(is_system, F.col(pos))), F.lit("")).alias("system"))
    text = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.concat(
        F.lit('{"type":"text","text":'), json_string(F.col("text")), F.lit("}")))
    call = lambda c: F.concat(F.lit('{"type":"tool_use","id":'), json_string(c["id"]), F.lit(',"name":'),
                              json_string(c["name"]), F.lit(',"input":'), c["args"], F.lit("}"))
    uses = F.when(F.coalesce(F.size("tool_calls"), F.lit(0)) > 0, _calls(call))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":'), json_string(F.coalesce("tool_call_id", F.lit("unknown"))),
                      F.lit(',"content":'), json_string(F.col("tool_result")), F.lit("}"))
    blocks = (F.when(F.col("role") == "user", text)
              .when(F.col("role") == "assistant", F.concat_ws(",", text, uses))
              .when(F.col("role") == "tool_result", result))
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    rows = messages.filter(~is_system).withColumn("_blocks", blocks).filter(F.coalesce("_blocks", F.lit("")) != "")
    return system, rows.withColumn("message", F.concat(
        F.lit('{"role":'), json_string(role), F.lit(',"content":['), F.col("_blocks"), F.lit("]}"))).drop("_blocks")


def split_prompt_expected(messages: DataFrame, key="conv_id", pos="pos"):
    """Return (prompt rows: every non-assistant message, expected: first assistant text per key)."""
    is_reply = F.col("role") == "assistant"
    expected = messages.filter(is_reply).groupBy(key).agg(F.min_by("text", pos).alias("expected"))
    return messages.filter(~is_reply), expected


def split_marked_text(text: Column, marker: str):
    """(prompt with its closing marker, expected answer) of a rendered text."""
    parts = F.split(text, "\\Q" + marker + "\\E")
    return F.concat(parts[0], F.lit(marker)), F.try_element_at(parts, F.lit(2))


def context_budget_flags(prompts: DataFrame, limits: DataFrame, model="model", text="prompt", tokens_per_word=1.5, tokens: Column | None = None) -> DataFrame:
    """Flag prompts that pass the model's context size.

    `tokens` is a tokenizer's count of the prompt, a column or a function's result; without it, or where it is null, the
    count is estimated from the words. A null prompt has no tokens; a model without a limit flags nothing.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    guess = F.ceil(words * F.lit(tokens_per_word)).cast("bigint")
    estimate = guess if tokens is None else F.coalesce(tokens.cast("bigint"), guess)
    counted = prompts.withColumn("estimate", estimate)  # before the join, so that the limits' columns can't hide those of `tokens`
    return counted.join(limits, model, "left").withColumn("too_long", F.coalesce(F.col("estimate") > F.col("context_length"), F.lit(False)))


def format_tool_results(results: DataFrame, style="text") -> DataFrame:
    """Add `item`: a tool result as a JSON text item or as {name, response}."""
    name, value, call_id = (json_string(F.col(c)) for c in ("tool_name", "tool_result", "tool_call_id"))
    if style == "functiongemma":
        item = F.concat(F.lit('{"name":'), name, F.lit(',"response":{"result":'), value, F.lit("}}"))
    else:
        inner = F.concat(F.lit('{"tool_name": '), name, F.lit(', "tool_call_id": '), call_id,
                         F.lit(', "tool_result": '), value, F.lit("}"))
        item = F.concat(F.lit('{"type":"text","text":'), json_string(inner), F.lit("}"))
    return results.withColumn("item", item)


def assemble_messages(examples: DataFrame, system_role=True, instruction=None, service_names=False,
                      tool_format="text") -> DataFrame:
    """Build the training entry of each example inside its own row, without a shuffle.

    Needs columns prompt, question and turns ARRAY<STRUCT<answer, tool_calls ARRAY<STRUCT<tool_name,
    service_name, args>>, results ARRAY<STRUCT<tool_name,tool_result>>, train_on_turn>>. Adds
    `messages`, the JSON array of system/user/assistant/tool messages.
    """
    item = lambda t: F.concat(F.lit('[{"type":"text","text":'), json_string(t), F.lit("}]"))
    msg = lambda role, content, train, extra=F.lit(""): F.concat(
        F.lit('{"role":"' + role + '","content":'), content, F.lit(',"train_on_turn":'), train.cast("string"), extra, F.lit("}"))
    prompt = F.col("prompt")
    if instruction is not None:
        prompt = F.concat(prompt, F.lit("\n"), instruction, F.lit(":"))
    off = F.lit(False)
    if system_role:
        opening = F.array(msg("system", item(prompt), off), msg("user", item(F.col("question")), off))
    else:
        opening = F.array(msg("user", item(F.concat(prompt, F.lit("\n"), F.col("question"))), off))
    shown = (lambda c: c["service_name"]) if service_names else (lambda c: c["tool_name"])
    given = lambda t: F.coalesce(F.size(t["results"]), F.lit(0)) > 0
    n_results = lambda t: F.when(F.size(t["tool_calls"]) == 0, 0).when(given(t), F.size(t["results"])).otherwise(F.size(t["tool_calls"]))

    def one_turn(t, i):
        calls = F.transform(t["tool_calls"], lambda c: F.concat(
            F.lit('{"function":{"name":'), json_string(shown(c)), F.lit(',"arguments":'), json_string(c["args"]), F.lit("}}")))
        has = F.size(t["tool_calls"]) > 0
        extra = F.when(has, F.concat(F.lit(',"tool_calls":['), F.array_join(calls, ","), F.lit("]"))).otherwise("")
        said = msg("assistant", item(t["answer"]), t["train_on_turn"], extra)
        # call ids count results over the whole conversation
        before = F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda a, x: a + n_results(x))
        rows = F.when(given(t), t["results"]).otherwise(F.transform(t["tool_calls"], lambda c: F.struct(
            shown(c).alias("tool_name"), F.lit("Success").alias("tool_result"))))
        def result_item(r, k):
            if tool_format == "functiongemma":
                return F.concat(F.lit('{"name":'), json_string(r["tool_name"]), F.lit(',"response":{"result":'),
                                json_string(r["tool_result"]), F.lit("}}"))
            inner = F.concat(F.lit('{"tool_name": '), json_string(r["tool_name"]), F.lit(', "tool_call_id": "call_'),
                             (before + k + 1).cast("string"), F.lit('", "tool_result": '), json_string(r["tool_result"]), F.lit("}"))
            return F.concat(F.lit('{"type":"text","text":'), json_string(inner), F.lit("}"))
        tool = msg("tool", F.concat(F.lit("["), F.array_join(F.transform(rows, result_item), ","), F.lit("]")), off)
        return F.when(has, F.array(said, tool)).otherwise(F.array(said))

    turns = F.flatten(F.transform("turns", one_turn))
    return examples.withColumn("messages", F.concat(
        F.lit("["), F.array_join(F.concat(opening, turns), ","), F.lit("]")))


def training_mask(pieces: DataFrame, key="conv_id", pos="pos", piece="piece", flag="train_on_turn") -> DataFrame:
    """Character span of every rendered piece and whether it is trained on."""
    spans = scan(pieces, [key], [pos], sums={"char_end": F.length(piece)})
    return spans.withColumns({"char_start": F.col("char_end") - F.length(piece),
                              "trainable": F.coalesce(F.col(flag), F.lit(False))})
