"""Call parsing and scoring on literal texts."""
import json

from dialoom import fixed
from dialoom.operators import completions as C
from dialoom.operators import scoring as S


def _normalized(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw_call string")
    return [r for r in C.normalize_tool_calls(df).orderBy("i").collect()]


def test_think_and_call(spark):
    text = '<think>which fan?</think>One moment. <tool_call>{"name":"light.dim","arguments":{"to_say":" Dimmed.","brightness":0.75}}</tool_call>'
    both = C.parse_completions(spark.createDataFrame([(text, True), (text, False)], "completion string, has_api boolean"))
    got = {r["has_api"]: r for r in both.collect()}
    assert "which fan" not in got[True]["response"] and got[True]["response"] == "One moment.  Dimmed." and len(got[True]["raw_calls"]) == 1
    assert got[False]["raw_calls"] == [] and got[False]["response"] == "One moment. "
    [call] = C.normalize_tool_calls(C.explode_calls(both.filter("has_api"))).collect()
    assert (call["tool_name"], json.loads(call["args"])) == ("light.dim", {"brightness": 191})


def test_forms(spark):
    rows = _normalized(
        spark,
        '{"name":"light.turn_on","arguments":{"brightness":0.25}}',
        'call:HassTurnOn{name:<escape>light.living_room<escape>}',
        '{"service":"light.turn_on","target_device":"light.a","rgb_color":"(1, 2,3)","brightness":1}',
        '{"name":"x","arguments":"{\\"b\\": 1.0, \\"a\\": [1, 2]}"}',
        '{"name":"x","arguments":"  "}',
        'not json', '{"name":"x"}', '{"name":"x","arguments":"oops"}', '[1]', '',
        '{"service":"light.turn_on","target_device":"a","brightness":"bright"}')
    assert [r["args"] for r in rows] == [
        '{"brightness":63}', '{"name":"light.living_room"}',
        '{"brightness":255,"rgb_color":[1,2,3],"service":"light.turn_on","target_device":"light.a"}',
        '{"a":[1,2],"b":1}', '{}', None, None, None, None, None, None]
    assert rows[2]["tool_name"] == fixed.SERVICE_TOOL
    assert [r["error"] for r in rows[5:]] == [fixed.ERR_NOT_JSON, fixed.ERR_BAD_FORM, fixed.ERR_BAD_ARGS, fixed.ERR_BAD_FORM,
                                              fixed.ERR_NOT_JSON, fixed.ERR_BAD_FORM]


def test_repeated_argument_keeps_last(spark):
    row, = _normalized(spark, "call:T{a:<escape>1<escape>,a:<escape>2<escape>}")
    assert row["args"] == '{"a":"2"}'


def test_unclosed_call(spark):
    df = spark.createDataFrame([('a<tool_call>{"name":"n","arguments":{}}', True)], "completion string, has_api boolean")
    assert C.parse_completions(df).first()["raw_calls"] == []
    got = C.parse_completions(df, allow_unclosed=True).first()
    assert got["raw_calls"] == ['{"name":"n","arguments":{}}'] and got["response"] == "a"


def _score(spark, expected, actual):
    call = lambda rows: spark.createDataFrame(rows, "k int, tool_name string, args string, error string")
    keys = sorted({r[0] for r in expected + actual} | {99})
    examples = spark.createDataFrame([(k,) for k in keys], "k int")
    return {r["k"]: r.asDict() for r in S.score_tool_calls(examples, call(expected), call(actual), ["k"]).collect()}


def test_multiset_matching(spark):
    same = (1, "t", '{"a":1}', None)
    got = _score(spark, [same, same, (2, "t", '{"a":1,"rgb_color":[1,2,3]}', None), (3, "t", "{}", None)],
                 [same, same, same, (2, "t", '{"a":1,"rgb_color":[9,9,9]}', None), (4, "t", "{}", None), (3, None, None, "bad")])
    assert (got[1]["possible"], got[1]["correct"], got[1]["mismatch"]) == (2, 2, 1)
    assert (got[2]["correct"], got[2]["color_mismatch"], got[2]["mismatch"]) == (1, 1, 0)
    assert (got[3]["correct"], got[3]["invalid_json"]) == (0, 1)
    assert (got[4]["possible"], got[4]["correct"], got[4]["extra_response"]) == (1, 0, 1)
    assert (got[99]["possible"], got[99]["correct"]) == (1, 1)


def test_matching_never_exceeds_expected(spark):
    import random
    rng = random.Random(1)
    row = lambda k: (k, "t", json.dumps({"a": rng.randint(0, 2)}, separators=(",", ":")), None)
    expected = [row(k) for k in range(20) for _ in range(rng.randint(0, 4))]
    actual = [row(k) for k in range(20) for _ in range(rng.randint(0, 4))]
    got = _score(spark, expected, actual)
    for k in range(20):
        want, have = [r[2] for r in expected if r[0] == k], [r[2] for r in actual if r[0] == k]
        hits = 0
        for c in have:
            if c in want:
                want.remove(c)
                hits += 1
        if [r for r in expected if r[0] == k]:
            assert got[k]["correct"] == hits
