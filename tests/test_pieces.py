"""Smaller operators on literal rows, file sources, and independence from partitioning."""
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from dialoom.functions import ordered, text
from dialoom.operators import extend as E
from dialoom.operators import extract as X
from dialoom.operators import messages as M
from dialoom.operators import sampling as S
from dialoom.sources import piles as P
from dialoom.sources import sft


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_title_case(spark):
    assert _one(spark, text.title_case(F.col("t")), t="todo_2nd dog's a-b") == "Todo_2Nd Dog'S A-B"


def test_fill_takes_values_literally(spark):
    got = _one(spark, text.fill(F.col("t"), {"a": F.lit("$1\\"), "b": F.lit(None)}), t="<a> <b> <a>")
    assert got == "$1\\ <b> $1\\"


def test_code_fence_and_json(spark):
    fenced = '```json\n{"a": 1}\n```'
    assert _one(spark, E.strip_code_fence(F.col("t")), t=fenced) == '{"a": 1}'
    assert _one(spark, E.extract_json_object(F.col("t")), t="x {\"a\": {\"b\": 1}} y") == '{"a": {"b": 1}}'
    assert _one(spark, E.extract_json_object(F.col("t")), t="} {") is None


def test_restore_markers(spark):
    pairs = [("<a> x <b>", "<eins> y <zwei>", "<a> y <b>"), ("<a>", "<1> <2>", "<a> <a>"), ("none", "keins", "keins"), ("<a> <b>", "nur <b>", "nur <b>")]
    df = spark.createDataFrame(pairs, "s string, t string, want string")
    for r in df.withColumn("got", E.restore_markers(F.col("s"), F.col("t"))).collect():
        assert r["got"] == r["want"]


def test_hosts(spark):
    hosts = {"localhost": True, "192.168.0.1": True, "256.1.1.1": False, "::1": True, "fe80::1": True, "a:b": False, "ha.local": True, " HA.Local ": True,
             "host": False, "-a.com": False, "": False, "a.c": False, "http://a.com": False}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["valid_host"] for r in X.flag_valid_hosts(df).collect()} == hosts
    assert _one(spark, X.host_of(F.col("u")), u="https://u@[fe80::1]:8080/x") == "fe80::1"


def test_bad_multiplier_fails(spark):
    df = spark.createDataFrame([("2",), ("many",)], "multiplier string")
    with pytest.raises(Exception, match="bad multiplier"):
        S.expand_multiplier(df).collect()
    assert S.expand_multiplier(spark.createDataFrame([("2",), ("0",), ("-1",)], "multiplier string")).count() == 2


def test_running_total_over_hot_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") % 3).alias("v"))
    got = ordered.running_total(df, ["k"], ["pos"], F.col("v"), "t", F.floor(F.col("pos") / 100)).orderBy("pos").collect()
    run = 0
    for r in got:
        run += r["v"]
        assert r["t"] == run


def test_one_text_per_conversation_whatever_its_positions(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), (F.col("id") * 60_000).alias("pos"), F.col("id").cast("string").alias("t"))
    assert [r["text"] for r in M.join_pieces(df, ["k"], "pos", "t", sep=",").collect()] == [",".join(map(str, range(25)))]


def test_name_likeness_is_bounded_in_the_jvm(spark):
    """The bound never lies below the exact ratio, and the pairs that are refused are those of the exact ratio alone."""
    r = random.Random(2)
    names = ["", "a", "kitchen_lamp", "kitchen lamp 2", "öl lampe", "lamp", *("".join(r.choice("abcdef_ é") for _ in range(r.randint(1, 14))) for _ in range(40)), "x" * 250]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for row in pairs.withColumn("bound", S.likeness_bound(F.col("a"), F.col("b"))).collect():
        assert row.bound >= SequenceMatcher(None, row.a, row.b).ratio() - 1e-12
    for limit in (0.4, 0.75):
        alike = {(x.a, x.b) for x in S.alike_names(pairs, "a", "b", limit).collect()}
        assert alike == {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= limit}


def test_context_devices_avoid_alike_names(spark):
    """Against difflib on every walked pair: nothing alike gets in, and whoever is left out has to be."""
    kinds = ["light", "fan"]
    names = [f"{k}.{w}_{n}" for k in kinds for w in ("kitchen", "kitchens", "garage", "bed_room", "zz") for n in ("lamp", "one", "q")]
    devices = spark.createDataFrame([(n, n) for n in names], "device_name string, description string")
    examples = spark.createDataFrame([(i, [names[i % len(names)], names[i * 7 % len(names)]]) for i in range(40)], "k bigint, avoid array<string>")
    got = {}
    for x in S.sample_context_devices(examples, devices, 4, ["k"], 64).collect():
        got.setdefault(x["k"], set()).add(x["device_name"])
    for x in examples.collect():
        fits = {n for n in names if all(a.split(".")[0] != n.split(".")[0] or SequenceMatcher(None, a, n.split(".")[1]).ratio() < 0.4 for a in x.avoid)}
        mine = got.get(x.k, set())
        assert mine <= fits and (mine == fits or len(mine) >= 2)


def test_walks_over_the_device_index_find_enough(spark):
    devices = spark.range(300).select(F.concat(F.when(F.col("id") % 60 == 0, "fan.").otherwise("light."), F.lit("d"), "id").alias("device_name"), F.lit("x").alias("description"))
    examples = spark.range(50).select(F.col("id").alias("k"), F.array(F.lit("light.d4")).alias("avoid"))
    for similar in (None, S.SIMILAR):  # with likeness nearly all lights are refused, so walks go on to the end
        by = {}
        for r in S.sample_context_devices(examples, devices, 1, ["k"], 8, similar=similar).collect():
            by.setdefault(r["k"], []).append(r["device_name"])
        assert len(by) == 50
        for names in by.values():
            assert 2 <= len(names) <= 8 and len(set(names)) == len(names) and "light.d4" not in names


def test_context_devices_stay_in_their_language(spark):
    devices = spark.createDataFrame([(l, f"{t}.{l}{i}", "x") for l in ("en", "pl") for t in ("light", "fan") for i in range(20)], "language string, device_name string, description string")
    examples = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "pl").when(F.col("id") % 3 == 1, "en").otherwise("xx").alias("language"), F.array(F.lit("light.en1")).alias("avoid"))
    rows = S.sample_context_devices(examples, devices, 1, ["k"], 30, similar=None).collect()
    assert {r["k"] % 3 for r in rows} == {0, 1} and all(("pl" in r["device_name"]) == (r["k"] % 3 == 0) for r in rows)


def test_draws_ignore_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    pick = lambda d: {r["k"]: r["x"] for r in d.select("k", S.draw_weighted_state(F.lit("vacuum"), 7, ["k"]).alias("x")).collect()}
    assert pick(df) == pick(df.repartition(13))
    shares = list(pick(df).values())
    assert 0.5 < shares.count("docked") / 500 < 0.7


def test_complete_batch(spark):
    def complete(talks):
        return ['{"a": 1}' if len(t) > 1 or "good" in t[0]["content"] else "no" for t in talks]
    df = spark.createDataFrame([("good",), ("late",), ("late",)], "prompt string")
    rows = E.complete_batch(df, complete, required=("a",), max_attempts=2).collect()
    assert sorted((r["prompt"], r["attempts"], r["error"]) for r in rows) == [("good", 1, None), ("late", 2, None), ("late", 2, None)]
    rows = E.complete_batch(df, complete, required=("a",), max_attempts=1).collect()
    assert {r["error"] for r in rows if r["prompt"] == "late"} == {"invalid JSON"}


def test_pile_files(spark, tmp_path):
    for lang in ("english", "polish"):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "pile_of_durations.csv").write_text('duration,name\n00:05:00,"five, or so"\n', encoding="utf8")
        (tmp_path / lang / "pile_of_and_words.csv").write_text(" and \nplus\n", encoding="utf8")
    rows = P.read_pile(spark, str(tmp_path), "durations").collect()
    assert {(r["duration"], r["name"], r["lang"]) for r in rows} == {("00:05:00", "five, or so", "english"), ("00:05:00", "five, or so", "polish")}
    assert {r["value"] for r in P.read_lines(spark, str(tmp_path), "pile_of_and_words.csv").collect()} == {"and", "plus"}
    missing = P.read_optional_pile(spark, str(tmp_path), "refusals")
    assert missing.count() == 0 and "desired_state" in missing.columns
    assert P.read_optional_pile(spark, str(tmp_path), "durations").count() == 2


def test_icl_file(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("﻿type,request,tool,response\nlight,Turn on <name>,T,ok\n", encoding="utf8")
    bad.write_text("type,request\nlight,x\n", encoding="utf8")
    assert P.read_icl_examples(spark, str(good)).first()["type"] == "light"
    with pytest.raises(ValueError):
        P.read_icl_examples(spark, str(bad))


def test_sft_shapes(spark, tmp_path):
    lines = [{"example_id": "1", "text": "plain"}, {"example_id": "2", "conversations": [{"from": "user", "value": "hi"}]},
             {"example_id": "3", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = sft.read_sft_jsonl(spark, str(tmp_path / "x.jsonl")).orderBy("example_id", "pos").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("text", "plain"), ("user", "hi"), ("user", "a\nb"), ("assistant", "c")]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "b.txt").write_bytes(b"no")
    kinds = spark.createDataFrame([("png", "image/png"), ("txt", "text/plain")], "extension string, mime_type string")
    good, bad = sft.load_images_base64(spark, str(tmp_path), kinds)
    assert [r["data"] for r in good.collect()] == ["iVBORw=="] and bad.count() == 1


def test_structured_output(spark):
    rows = [("none", "free", None, None), ("structure", '{"foo": 1}', None, None), ("structure", "not-json", None, None), ("tool", "", '{"a":1}', None), ("tool", "", None, None)]
    df = spark.createDataFrame(rows, "method string, raw_text string, tool_args string, errors string")
    got = X.extract_structured_output(df, F.col("errors")).collect()
    assert [r["data"] for r in got] == ["free", '{"foo":1}', None, '{"a":1}', None]
    assert [r["error"] is None for r in got] == [True, True, False, True, False]
