"""Inputs that go wrong elsewhere: quotes, short answers, other headers, string keys, calls inside thinking."""
import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions.args import canonical_args, json_object
from dialoom.functions.stage import stage_dir
from dialoom.operators import extend as E
from dialoom.operators import extract as X
from dialoom.operators import generate as G
from dialoom.operators import messages as M
from dialoom.operators import render as R
from dialoom.operators import scoring as S
from dialoom.operators import validate as V
from dialoom.sources import piles, sft
from dialoom.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("a, b", [("1e16", "10000000000000000"), ("1e20", "100000000000000000000"), ("2", "2.0"), ("-3.0", "-3")])
def test_equal_numbers_have_equal_json(spark, a, b):
    text = lambda v: one(spark, canonical_args(json_object(F.lit('{"k": %s}' % v))))
    assert text(a) == text(b)


@pytest.mark.parametrize("given, want", [('{"name": "other"}', {"name": "other", "k": 1}), ("{broken}", {"name": "x", "k": 1}), ("", {"name": "x", "k": 1}), ('{"z": [1]}', {"name": "x", "k": 1, "z": [1]})])
def test_given_arguments_update_the_others(spark, given, want):
    assert json.loads(one(spark, G.merged_args(F.lit('{"name": "x", "k": 1}'), F.lit(given)))) == want


def test_tool_schemas_are_json(spark):
    rows = spark.createDataFrame([('say "hi"', 'a "quoted" \\ text', 0, "p\"1", "the \"p\"", "integer", True, 0.0, 100.0, None), ('say "hi"', "", 1, "list", None, "array", False, None, None, "string")],
                                 "tool string, description string, param_pos int, param string, param_description string, type string, required boolean, minimum double, maximum double, item_type string")
    r = R.format_tools(rows).collect()[0]
    shape = json.loads(r["schema"])["function"]["parameters"]
    assert json.loads(r["input_schema"])["input_schema"] == shape and shape["required"] == ['p"1']
    assert shape["properties"]['p"1'] == {"type": "integer", "description": 'the "p"', "minimum": 0.0, "maximum": 100.0}
    assert shape["properties"]["list"] == {"type": "array", "items": {"type": "string"}}


def test_completions_that_fail(spark):
    def complete(talks):
        assert talks[0][0] == {"role": "system", "content": "be brief"}
        if any("boom" in t[1]["content"] for t in talks):
            raise RuntimeError("down")
        return ["fine"] * (len(talks) - 1)
    df = spark.createDataFrame([("boom",), ("a",), (None,)], "prompt string")
    rows = {r["prompt"]: r for r in E.complete_batch(df, complete, max_attempts=2, partitions=1, system="be brief").collect()}
    assert len(rows) == 3 and rows["boom"]["error"] == "RuntimeError: down" and rows["boom"]["attempts"] == 2
    assert rows[None]["error"] == "no prompt" and rows[None]["answer"] is None
    short = E.complete_batch(df.where("prompt = 'a'"), complete, max_attempts=2, system="be brief").collect()[0]
    assert short["error"] == "no answer" and short["attempts"] == 2


def test_untranslated_text_stays(spark):
    rows = spark.createDataFrame([("Hello <x>", "light.lamp"), ("Bye", "light.sun"), (None, "light.lamp")], "phrase string, device string")
    table = spark.createDataFrame([("Hello <x>", "Hallo <y>"), ("lamp", "Lampe")], "source string, translated string")
    got = [tuple(r) for r in E.translate_piles(rows, ["phrase", "device"], table, "device").collect()]
    assert sorted(got, key=str) == sorted([("Hallo <x>", "light.lampe", []), ("Bye", "light.sun", ["phrase", "device"]), (None, "light.lampe", [])], key=str)


def test_calls_are_matched_by_name_and_arguments(spark):
    calls = lambda name, args: spark.createDataFrame([(1, name, args, None)], "k int, tool_name string, args string, error string")
    scored = S.score_tool_calls(spark.createDataFrame([(1,)], "k int"), calls("a|b", "c"), calls("a", "b|c"), ["k"]).collect()[0]
    assert scored["correct"] == 0


def test_piles_are_read_by_header(spark):
    root = stage_dir(spark)
    for lang, names in (("english", ["service_name", "device_name", "arguments", "phrase"]), ("polish", ["phrase", "device_name", "service_name"])):
        spark.createDataFrame([tuple(f"{lang} {n}" for n in names)], ", ".join(f"{n} string" for n in names)).write.csv(f"{root}/{lang}/pile_of_specific_actions.csv", header=True)
    got = {r["lang"]: r for r in piles.read_pile(spark, root, "specific_actions").collect()}
    assert got["english"]["phrase"] == "english phrase" and got["english"]["arguments"] == "english arguments"
    assert got["polish"]["service_name"] == "polish service_name" and got["polish"]["arguments"] is None
    assert piles.read_optional_pile(spark, root, "responses").count() == 0


def test_entries_with_tools_and_without_ids(spark):
    path = stage_dir(spark)
    rows = spark.createDataFrame([("1", '[{"role":"user","content":"a"}]', '[{"name":"t"}]')], "example_id string, messages string, tools string")
    sft.write_sft_jsonl(rows, path)
    line = json.loads(spark.read.text(path).collect()[0][0])
    assert line["tools"] == [{"name": "t"}]
    bare = stage_dir(spark)
    spark.createDataFrame([('{"text":"x"}',), ('{"text":"y"}',)], "value string").write.text(bare)
    assert len({r["example_id"] for r in sft.read_sft_jsonl(spark, bare).collect()}) == 2


def test_chunks_with_string_keys_out_of_order_and_calls_in_thinking(spark):
    streams.use_rocksdb(spark)
    text = "hi <think>a <tool_call>{}</tool_call> </think>bye <think>open <tool_call>x</tool_call> end"
    chunks = [("c1", i, text[i * 5:i * 5 + 5], i * 5 + 5 >= len(text)) for i in range((len(text) + 4) // 5)]
    path = stage_dir(spark)
    schema = "conv_id string, seq int, content string, is_last boolean"
    for part in (chunks[10:], chunks[:10]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = sorted(streams.run_to_table(streams.parse_completion_stream(stream)).collect(), key=lambda r: r["out_seq"])
    assert [r["content"] for r in rows if r["kind"] == "call"] == ["{}", "x"]
    assert "".join(r["content"] for r in rows if r["kind"] == "text") == "hi bye <think>open  end" and {r["conv_id"] for r in rows} == {"c1"}


def test_streams_without_rows(spark):
    path = stage_dir(spark)
    spark.createDataFrame([], "msg_id string, completion string").write.parquet(path)
    good, bad = streams.stream_dead_letters(spark.readStream.schema("msg_id string, completion string").parquet(path), ["msg_id"])
    assert good.count() == bad.count() == 0


def test_entries_offer_tools(spark):
    every = json.loads(one(spark, V.tools_json()))
    assert len(every) == 19 and every[3]["function"]["parameters"]["properties"]["position"] == {"type": "integer", "description": "Position from 0-100", "minimum": 0, "maximum": 100}
    some = json.loads(one(spark, V.tools_json(F.array(F.lit("HassTurnOff"), F.lit("unknown"), F.lit("HassToggle")))))
    assert [t["function"]["name"] for t in some] == ["HassTurnOff", "HassToggle"]
    services = json.loads(one(spark, V.tools_json(service_names=True)))
    assert len(services) == 36 and services[0]["function"]["parameters"]["required"] == ["target_device"]


def test_service_tools_are_checked(spark):
    calls = spark.createDataFrame([("light.turn_on", '{"target_device": "light.a", "brightness": 3}'), ("todo.add_item", '{"target_device": "todo.a"}'), ("climate.set_humidity", '{"target_device": "c", "humidity": 101}')],
                                  "tool_name string, args string")
    got = {r["tool_name"]: r["errors"] for r in V.validate_tool_calls(calls, V.intent_catalog(spark).union(V.service_catalog(spark))).collect()}
    assert got == {"light.turn_on": None, "todo.add_item": "required key not provided @ item", "climate.set_humidity": "value too large @ humidity"}


def test_model_rules_from_a_table(spark):
    table = spark.createDataFrame([(1, "home-", "tool_call_prefix", "<<"), (1, "home-", "context_length", "4096"), (2, "llama", None, None)], "pos int, key string, option string, value string")
    got = V.apply_model_rules(spark.createDataFrame([("My-Home-Llama",), ("llama-3",)], "model string"), rules=V.rules_from_table(table)).collect()
    assert [r["rule"] for r in got] == ["home-", "llama"] and got[0]["options"]["context_length"] == "4096"


@pytest.mark.parametrize("style", ["chatml", "zephyr", "gemma3", "functiongemma", "zephyr_legacy"])
def test_tools_per_conversation(spark, style):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind", "T1"), (1, 1, "user", "Hi", "T1"), (2, 0, "system", "Be kind", None), (2, 1, "user", "Hi", None)], "conv_id int, pos int, role string, text string, own string")
    rows = rows.withColumns({"tool_calls": F.lit(None).cast("array<struct<id:string,name:string,args:string>>"), "tool_name": F.lit(None).cast("string"), "tool_result": F.lit(None).cast("string")})
    got = {r["conv_id"]: r["text"] for r in R.render_chat(rows, style, F.col("own")).collect()}
    single = lambda k, t: R.render_chat(rows.where(F.col("conv_id") == k), style, t).collect()[0]["text"]
    assert got == {1: single(1, "T1"), 2: single(2, None)} and "T1" in got[1]


def test_contents_given_as_lists(spark):
    rows = spark.createDataFrame([("chat", '{"object":"chat.completion","choices":[{"message":{"content":[{"type":"text","text":"a"},"b",{"x":1}]}}]}'), ("local", '{"message":{"content":["c",{"text":"d"}]}}'),
                                  ("chat", '{"object":"chat.completion","choices":[{"message":{"content":"[not a list"}}]}')], "provider string, body string")
    assert [r["content"] for r in X.extract_provider_responses(rows).collect()] == ["ab", "cd", "[not a list"]


def test_attachments(spark):
    rows = spark.createDataFrame([(0, "user", "hi", [("image/png", "QQ")]), (1, "user", "no", [("text/plain", "QQ")]), (2, "user", "bare", None), (3, "system", "s", None)],
                                 "pos int, role string, text string, attachments array<struct<mime_type:string,data:string>>").coalesce(1).sortWithinPartitions("pos")
    rows = rows.withColumns({"tool_calls": F.lit(None).cast("array<struct<id:string,name:string,args:string>>"), "tool_call_id": F.lit(""), "tool_name": F.lit(""), "tool_result": F.lit("")})
    got = M.to_openai_messages(rows, content_as_list=True).collect()
    assert json.loads(got[0]["message"])["content"] == [{"type": "text", "text": "hi"}, {"type": "image_url", "image_url": {"url": "QQ"}}]
    assert got[1]["message"] is None and got[1]["error"] and json.loads(got[2]["message"])["content"] == [{"type": "text", "text": "bare"}]
    flat = M.to_openai_messages(rows).collect()
    assert json.loads(flat[0]["message"]) == {"role": "user", "content": "hi", "images": ["QQ"]} and json.loads(flat[2]["message"]) == {"role": "user", "content": "bare"}
    assert json.loads(flat[3]["message"])["role"] == "system"


def test_generated_names_personas_and_failures(spark):
    def complete(talks):
        return ["Hall Lamp\n\n Bob's Fan " if "names" in t[0]["content"] else '"You are P"' for t in talks]
    names = E.generate_device_names(spark.createDataFrame([("light",)], "type string"), complete).collect()
    assert {tuple(r) for r in names} == {("light.hall_lamp", "Hall Lamp"), ("light.bobs_fan", "Bob's Fan")}
    people = E.generate_persona_prompts(spark.createDataFrame([("pirate", "salty")], "persona string, about string"), complete).collect()
    assert [tuple(r) for r in people] == [("pirate", "You are P")]
    rows = spark.createDataFrame([("lock.lock", "lock.door", "the door", '{"phrase": "Lock it", "bad_device": "lock.dor", "retry_prompt": "Again"}'), ("lock.lock", "lock.b", "b", '{"phrase": "x"}')],
                                 "service_name string, device_name string, description string, answer string")
    good, bad = E.failed_call_rows(rows)
    row = good.collect()[0]
    assert row["bad_device_name"] == "lock.dor" and "lock.dor" in row["error_result"] and row["correct_device_name"] == "lock.door" and bad.count() == 1
    asked = E.build_generation_prompts(rows.withColumn("candidates", F.array(F.lit("lock.a"))), "failed", F.lit("german")).collect()[0]["prompt"]
    assert asked.endswith("lock.a")


def test_a_pile_in_another_language(spark):
    rows = spark.createDataFrame([("light.lamp", "the lamp"), ("sensor.x", "the x")], "device_name string, description string")
    table = spark.createDataFrame([("lamp", "Große Lampe"), ("the lamp", "die Lampe")], "source string, translated string")
    assert [tuple(r)[:2] for r in E.translate_pile(rows, "device_names", table).collect()] == [("light.große_lampe", "die Lampe")]


def test_several_results_in_one_message(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi", None), (1, 1, "tool_result", None, [("a", '{"x":1}'), ("b", '{"y":2}')])],
                                 "conv_id int, pos int, role string, text string, tool_results array<struct<tool_name:string,tool_result:string>>")
    rows = rows.withColumns({"tool_calls": F.lit(None).cast("array<struct<id:string,name:string,args:string>>"), "tool_name": F.lit(None).cast("string"), "tool_result": F.lit(None).cast("string")})
    text = lambda style: R.render_chat(rows, style).collect()[0]["text"]
    assert '<tool_result>{"x":1}</tool_result>\n<tool_result>{"y":2}</tool_result>' in text("gemma3")
    assert "response:a{x:1}<end_function_response><start_function_response>response:b{y:2}<end_function_response>" in text("functiongemma")
