"""Queries: completion parsing and call scoring."""
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.operators import completions as C
from dialoom.operators import scoring as S
from dialoom.plans.inputs import spark_input, with_inputs

KEYS = ["example_id"]


def sql_normalize(src, raw="raw_call", keep="*"):
    """DuckDB text: normalised calls from a table with a raw call column (json functions)."""
    strings = "['service','target_device','rgb_color','fan_mode','hvac_mode','preset_mode','duration','item']"
    numbers = "['brightness','temperature','humidity']"
    return f"""
n1 AS (SELECT *, CASE WHEN trim({raw}) LIKE '{{%}}' AND json_valid({raw}) THEN {raw}::JSON END AS j,
       json_valid({raw}) AS valid FROM {src}),
n2 AS (SELECT *, json_keys(j) AS ks, json_type(j,'$.name') AS tn, json_type(j,'$.arguments') AS ta FROM n1),
n3 AS (SELECT *, CASE
    WHEN j IS NOT NULL AND list_sort(ks) = ['arguments','name'] AND tn = 'VARCHAR' AND ta IN ('VARCHAR','OBJECT') THEN 'named'
    WHEN j IS NOT NULL AND list_contains(ks,'service') AND list_contains(ks,'target_device')
      AND len(list_filter(ks, lambda x: NOT list_contains({strings} || {numbers}, x))) = 0
      AND len(list_filter(ks, lambda x: list_contains({strings}, x) AND json_type(j, '$.' || x) <> 'VARCHAR')) = 0
      AND len(list_filter(ks, lambda x: list_contains({numbers}, x) AND TRY_CAST(json_extract_string(j, '$.' || x) AS DOUBLE) IS NULL)) = 0 THEN 'service'
    WHEN valid THEN 'other'
    WHEN regexp_matches({raw}, 'call:\\w+\\{{.+\\}}') THEN 'call'
    WHEN {raw} IS NOT NULL THEN 'none' END AS form FROM n2),
n4 AS (SELECT *,
    CASE WHEN form = 'named' AND ta = 'VARCHAR' THEN
           CASE WHEN trim(json_extract_string(j,'$.arguments')) = '' THEN '{{}}'::JSON
                WHEN json_valid(json_extract_string(j,'$.arguments')) THEN json_extract_string(j,'$.arguments')::JSON END
         WHEN form = 'named' THEN json_extract(j,'$.arguments')
         WHEN form = 'service' THEN j
         WHEN form = 'call' THEN ('{{' || array_to_string(list_transform(regexp_extract_all(regexp_extract({raw}, 'call:\\w+\\{{(.+)\\}}', 1), '(\\w+):<escape>(.+?)<escape>'),
              lambda x: '"' || regexp_extract(x, '(\\w+):', 1) || '":' || to_json(regexp_extract(x, '<escape>(.+?)<escape>', 1))::VARCHAR), ',') || '}}')::JSON
    END AS a,
    CASE form WHEN 'named' THEN json_extract_string(j,'$.name') WHEN 'service' THEN 'HassCallService'
              WHEN 'call' THEN regexp_extract({raw}, 'call:(\\w+)\\{{', 1) END AS tool_name FROM n3),
normalized AS (SELECT {keep}, tool_name,
    CASE WHEN a IS NOT NULL THEN '{{' || array_to_string(list_sort(list_transform(list_filter(json_keys(a), lambda k: k <> 'to_say'), lambda k: '"' || k || '":' ||
       CASE WHEN k = 'brightness' AND TRY_CAST(json_extract_string(a,'$.brightness') AS DOUBLE) > 0 AND TRY_CAST(json_extract_string(a,'$.brightness') AS DOUBLE) <= 1
              THEN CAST(floor(CAST(json_extract_string(a,'$.brightness') AS DOUBLE) * 255) AS BIGINT)::VARCHAR
            WHEN k = 'rgb_color' AND json_type(a,'$.rgb_color') = 'VARCHAR'
              THEN '[' || replace(replace(replace(json_extract_string(a,'$.rgb_color'),'(',''),')',''),' ','') || ']'
            WHEN json_type(a, '$.' || k) = 'DOUBLE' THEN regexp_replace(json_extract_string(a, '$.' || k), '\\.0+$', '')
            ELSE replace(json_extract(a, '$.' || k)::VARCHAR, CASE WHEN json_type(a, '$.' || k) = 'ARRAY' THEN ' ' ELSE chr(1) END, '') END)), ',') || '}}' END AS args,
    CASE WHEN a IS NOT NULL THEN coalesce(json_extract_string(a,'$.to_say'), '') END AS to_say,
    CASE WHEN form = 'none' THEN '{fixed.ERR_NOT_JSON}' WHEN form = 'other' THEN '{fixed.ERR_BAD_FORM}'
         WHEN form IS NOT NULL AND a IS NULL THEN '{fixed.ERR_BAD_ARGS}' END AS error FROM n4)"""


TOOL_RE = "<tool_call>(.*?)</tool_call>"
BLOCKS = f"""parsed AS (SELECT *, CASE WHEN has_api THEN regexp_extract_all(completion, '{TOOL_RE}', 1, 's') ELSE [] END AS raw_calls,
  regexp_replace(regexp_replace(completion, '<think>(.*?)</think>', '', 'gs'), '{TOOL_RE}', '', 'gs') AS body FROM completions),
calls AS (SELECT conv_id, turn, unnest(raw_calls) AS raw_call, CAST(generate_subscripts(raw_calls, 1) - 1 AS INT) AS call_pos FROM parsed)"""
NORM = BLOCKS + "," + sql_normalize("calls", keep="conv_id, turn, call_pos, raw_call")


def _calls(spark, sf_dir):
    parsed = C.parse_completions(spark_input(spark, sf_dir, "completions"))
    return C.normalize_tool_calls(C.explode_calls(parsed, "conv_id", "turn"))


def x1_parse_completions(spark, sf_dir):
    parsed = C.parse_completions(spark_input(spark, sf_dir, "completions"))
    return parsed.select("conv_id", "turn", "response", F.size("raw_calls").cast("bigint").alias("n_calls"),
                         F.concat_ws("\n", "raw_calls").alias("raw_calls"))


def x1_parse_unclosed(spark, sf_dir):
    parsed = C.parse_completions(spark_input(spark, sf_dir, "completions"), allow_unclosed=True)
    return parsed.select("conv_id", "turn", "response", F.concat_ws("\n", "raw_calls").alias("raw_calls"))


def x2_normalize_tool_calls(spark, sf_dir):
    return _calls(spark, sf_dir).select("conv_id", "turn", "call_pos", "tool_name", "args", "to_say", "error")


def x3_dead_letter_calls(spark, sf_dir):
    _, messages = C.dead_letter_calls(_calls(spark, sf_dir), ["conv_id", "turn", "call_pos"])
    return messages


def _event_calls(spark, sf_dir, name):
    rows = spark_input(spark, sf_dir, name).select("example_id", "completion")
    blocks = C.extract_blocks(rows)
    return C.normalize_tool_calls(C.explode_calls(blocks, "example_id"))


def scored(spark, sf_dir):
    examples = spark_input(spark, sf_dir, "gold").select("model", "checkpoint", "language", *KEYS).distinct()
    return S.score_tool_calls(examples, _event_calls(spark, sf_dir, "gold"), _event_calls(spark, sf_dir, "predicted"), KEYS)


def a4_score_tool_calls(spark, sf_dir):
    return scored(spark, sf_dir)


def a5_classify_failures(spark, sf_dir):
    return S.classify_failures(scored(spark, sf_dir), KEYS)


def a6_accuracy_rollup(spark, sf_dir):
    return S.accuracy_report(scored(spark, sf_dir))


def w6_checkpoint_progress(spark, sf_dir):
    by = scored(spark, sf_dir).groupBy("model", F.when(F.col("checkpoint") == 4, F.lit("final")).otherwise(
        F.concat(F.lit("step-"), (F.col("checkpoint") * 500).cast("string"))).alias("checkpoint")).agg(
        (F.sum("correct") / F.sum("possible")).alias("accuracy"))
    return S.checkpoint_progress(by)


SCORE_SQL = f"""e AS (SELECT example_id, unnest(regexp_extract_all(completion, '{TOOL_RE}', 1, 's')) AS raw_call FROM gold),
p AS (SELECT example_id, unnest(regexp_extract_all(completion, '{TOOL_RE}', 1, 's')) AS raw_call FROM predicted),
both_calls AS (SELECT 'e' AS side, * FROM e UNION ALL SELECT 'a', * FROM p),
{sql_normalize("both_calls", keep="side, example_id, raw_call")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY side, example_id, tool_name, args, error) AS rn FROM normalized),
ge AS (SELECT * FROM ranked WHERE side = 'e'), ga AS (SELECT * FROM ranked WHERE side = 'a' AND error IS NULL),
hits AS (SELECT ge.example_id, ge.tool_name, ge.args, ge.rn FROM ge JOIN ga USING (example_id, tool_name, args, rn)),
strip AS (SELECT side, example_id, tool_name, regexp_replace(args, ',"rgb_color":\\[[^\\]]*\\]', '') AS loose,
    row_number() OVER (PARTITION BY side, example_id, tool_name, regexp_replace(args, ',"rgb_color":\\[[^\\]]*\\]', '')) AS rn
  FROM (SELECT * FROM ge UNION ALL SELECT * FROM ga) r ANTI JOIN hits USING (example_id, tool_name, args, rn)
  WHERE args LIKE '%"rgb_color":%'),
near AS (SELECT example_id, count(*) AS n FROM strip x JOIN strip y USING (example_id, tool_name, loose, rn)
  WHERE x.side = 'e' AND y.side = 'a' GROUP BY 1),
scored AS (SELECT x.model, x.checkpoint, x.language, x.example_id,
    greatest(ne, 1) AS possible, CASE WHEN ne = 0 THEN CASE WHEN nf = 0 THEN 1 ELSE 0 END ELSE hit + nr END AS correct, nr AS color_mismatch,
    CASE WHEN ne = 0 AND nf > 0 THEN 1::BIGINT ELSE 0 END AS extra_response,
    CASE WHEN ne > 0 AND nf = 0 THEN 1::BIGINT ELSE 0 END AS no_response_found,
    CASE WHEN ne > 0 AND nf > 0 THEN bad ELSE 0 END AS invalid_json,
    CASE WHEN ne > 0 AND nf > 0 THEN nf - bad - hit - nr ELSE 0 END AS mismatch
  FROM (SELECT DISTINCT model, checkpoint, language, example_id FROM gold) x
  JOIN (SELECT g.example_id, (SELECT count(*) FROM ge WHERE ge.example_id = g.example_id) AS ne,
      (SELECT count(*) FROM ranked r WHERE r.side = 'a' AND r.example_id = g.example_id) AS nf,
      (SELECT count(*) FROM ranked r WHERE r.side = 'a' AND r.error IS NOT NULL AND r.example_id = g.example_id) AS bad,
      (SELECT count(*) FROM hits h WHERE h.example_id = g.example_id) AS hit,
      coalesce((SELECT n FROM near WHERE near.example_id = g.example_id), 0) AS nr
    FROM (SELECT DISTINCT example_id FROM gold) g) c USING (example_id))"""

QUERIES = {f.__name__: f for f in (x1_parse_completions, x1_parse_unclosed, x2_normalize_tool_calls, x3_dead_letter_calls,
                                   a4_score_tool_calls, a5_classify_failures, a6_accuracy_rollup, w6_checkpoint_progress)}

_LAST = BLOCKS + ", lastcalls AS (SELECT *, CASE WHEN len(raw_calls) > 0 THEN raw_calls[-1] END AS raw_call FROM parsed)," + \
    sql_normalize("lastcalls", keep="conv_id, turn, body, raw_calls")
_OPEN = BLOCKS.replace("completion,", "fixed_completion,").replace(
    "FROM completions)", f"""FROM (SELECT *, CASE WHEN contains(regexp_replace(completion, '{TOOL_RE}', '', 'gs'), '<tool_call>')
  THEN completion || '</tool_call>' ELSE completion END AS fixed_completion FROM completions))""") + \
    ", lastcalls AS (SELECT *, CASE WHEN len(raw_calls) > 0 THEN raw_calls[-1] END AS raw_call FROM parsed)," + \
    sql_normalize("lastcalls", keep="conv_id, turn, body, raw_calls")

ORACLES = {
    "x1_parse_completions": with_inputs("completions", tail=_LAST) + """
SELECT conv_id, turn, body || coalesce(to_say, '') AS response, len(raw_calls) AS n_calls,
  array_to_string(raw_calls, chr(10)) AS raw_calls FROM normalized""",
    "x1_parse_unclosed": with_inputs("completions", tail=_OPEN) + """
SELECT conv_id, turn, body || coalesce(to_say, '') AS response, array_to_string(raw_calls, chr(10)) AS raw_calls FROM normalized""",
    "x2_normalize_tool_calls": with_inputs("completions", tail=NORM) + """
SELECT conv_id, turn, call_pos, tool_name, args, to_say, error FROM normalized""",
    "x3_dead_letter_calls": with_inputs("completions", tail=NORM) + f"""
SELECT conv_id, turn, call_pos, part, CASE part WHEN 0 THEN 'assistant' ELSE 'tool_result' END AS role, 'unknown' AS tool_name,
  CASE part WHEN 0 THEN '[{{"args":{{}},"name":"unknown"}}]'
    ELSE '{{"error":' || to_json('Error occurred calling tool with args=''' || raw_call || ''': ' || error)::VARCHAR || '}}' END AS content
FROM normalized, (VALUES (0), (1)) v(part) WHERE error IS NOT NULL""",
    "a4_score_tool_calls": with_inputs("gold", "predicted", tail=SCORE_SQL) + "SELECT * FROM scored",
    "a5_classify_failures": with_inputs("gold", "predicted", tail=SCORE_SQL) + """
SELECT example_id, failure, n FROM (UNPIVOT (SELECT example_id, extra_response, no_response_found, invalid_json, mismatch FROM scored)
  ON extra_response, no_response_found, invalid_json, mismatch INTO NAME failure VALUE n) WHERE n > 0""",
    "a6_accuracy_rollup": with_inputs("gold", "predicted", tail=SCORE_SQL) + """
SELECT model, checkpoint, language, CAST(grouping(model, checkpoint, language) AS BIGINT) AS level, CAST(sum(possible) AS BIGINT) AS possible,
  CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(color_mismatch) AS BIGINT) AS color_mismatch, sum(correct) / sum(possible) AS accuracy
FROM scored GROUP BY ROLLUP (model, checkpoint, language)""",
    "w6_checkpoint_progress": with_inputs("gold", "predicted", tail=SCORE_SQL) + """
, r AS (SELECT model, CASE WHEN checkpoint = 4 THEN 'final' ELSE 'step-' || (checkpoint * 500) END AS checkpoint,
    CASE WHEN checkpoint < 4 THEN checkpoint * 500 END AS step, sum(correct) / sum(possible) AS accuracy FROM scored GROUP BY ALL)
SELECT model, checkpoint, accuracy, step, CAST(row_number() OVER w AS INT) AS place, accuracy - lag(accuracy) OVER w AS gain,
  row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, step NULLS LAST, checkpoint) = 1 AS is_best
FROM r WINDOW w AS (PARTITION BY model ORDER BY step NULLS LAST, checkpoint)""",
}
