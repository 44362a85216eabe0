"""Queries: extraction, validation and rules."""
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.stage import stage_dir
from dialoom.operators import completions as C
from dialoom.operators import extract as X
from dialoom.operators import validate as V
from dialoom.operators.changed import ChangedParts
from dialoom.plans.inputs import TEXTS, spark_input, with_inputs
from dialoom.plans.generate import L

NL = "chr(10)"
TEXTS |= {
    "fenced": f"""
SELECT conv_id, turn, text || {NL} || '```call' || {NL} || '{{{{"service": "light.turn_on", "k": ' || CAST(turn AS STRING) || '}}}}' || {NL} || {NL}
   || CASE WHEN turn % 3 = 0 THEN '{{{{bad json}}}}' || {NL} ELSE '' END || '```' || CASE WHEN turn % 2 = 0 THEN ' and ```call' || {NL} || '{{{{"service": "fan.toggle"}}}}```' ELSE '' END AS text
FROM {{conversations}}""",
    "prompts": """
SELECT home_id, place, domain || '.' || suffix || ' ''' || friendly_name || ''' = on;a.b plain' || chr(10) || domain || '.other_' || CAST(place AS STRING) || ' = off. Services: ' || domain || '.turn_on(a,b), x.y(z)' AS prompt
FROM {registry}""",
    "response_log": """
SELECT event_id, CASE WHEN event_id % 10 < 5 THEN 'chat' WHEN event_id % 10 < 9 THEN 'responses' ELSE 'local' END AS provider,
  CASE event_id % 10
   WHEN 0 THEN '{{"object":"chat.completion","choices":[{{"message":{{"content":"hi ' || event_type || '"}},"finish_reason":"length"}}]}}'
   WHEN 1 THEN '{{"object":"chat.completion.chunk","choices":[{{"delta":{{"content":"part"}}}}]}}'
   WHEN 2 THEN '{{"object":"chat.completion.chunk","choices":[{{"delta":{{"tool_calls":[{{"function":{{"name":"' || event_type || '","arguments":"a' || CAST(user_id AS STRING) || '"}}}}]}},"finish_reason":"stop"}}]}}'
   WHEN 3 THEN '{{"object":"text_completion","choices":[{{"text":"old ' || event_type || '"}}]}}'
   WHEN 4 THEN '{{"object":"chat.completion","choices":[]}}'
   WHEN 5 THEN '{{"object":"response","id":"r","status":"completed","output":[{{"type":"message","content":[{{"type":"output_text","text":"t' || CAST(user_id AS STRING) || '"}}]}}]}}'
   WHEN 6 THEN '{{"object":"response","id":"r","status":"incomplete","output":[{{"type":"message","content":[{{"type":"refusal","refusal":"no"}}]}}]}}'
   WHEN 7 THEN '{{"object":"response","output":[]}}'
   WHEN 8 THEN '{{"object":"response","id":"r","status":"failed","output":[],"error":{{"message":"' || event_type || ' failed"}}}}'
   ELSE '{{"message":{{"content":"loc","tool_calls":[{{"function":{{"name":"n","arguments":"' || event_type || '"}}}}]}}}}' END AS body
FROM {events}""",
    "sse": """
SELECT user_id AS stream_id, event_id AS line_no, CASE WHEN event_id % 37 = 0 THEN ' data: [DONE] ' WHEN event_id % 53 = 0 THEN 'error: ' || event_type WHEN event_id % 5 = 0 THEN '  '
  WHEN event_id % 5 = 1 THEN event_type ELSE 'data: ' || props || ' ' END AS line FROM {events}""",
    "tasks": """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'structure' ELSE 'tool' END AS method, 'HassSetPosition' AS tool_name,
  CASE WHEN event_id % 4 = 0 THEN 'not-json ' || event_type ELSE props END AS raw_text,
  CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 7 = 1 THEN '{{"name":5}}' ELSE '{{"name":"' || event_type || '","position":' || CAST(user_id AS STRING) || '}}' END AS tool_args
FROM {events}""",
    "agent_calls": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HassSetPosition' WHEN 1 THEN 'HassLightSet' WHEN 2 THEN 'HassCallService' WHEN 3 THEN 'HassNothing' WHEN 4 THEN 'HassSetVolume' ELSE 'HassTurnOn' END AS tool_name,
  CASE event_id % 6 WHEN 0 THEN '{{"position":' || substr(props, 7, length(props) - 7) || CASE WHEN event_id % 4 = 0 THEN '.5' ELSE '' END || '}}'
   WHEN 1 THEN '{{"brightness":' || CAST(user_id AS STRING) || ',"hue":1}}'
   WHEN 2 THEN '{{"service":"' || CASE event_id % 5 WHEN 0 THEN 'light.turn_on' WHEN 1 THEN 'script.press' WHEN 2 THEN 'light' WHEN 3 THEN 'door.open' ELSE 'fan.explode' END || '","target_device":"d","brightness":' || CAST(user_id AS STRING) || ',"x":1}}'
   WHEN 4 THEN '{{"volume_level":"loud"}}' WHEN 5 THEN '{{"domain":["light"],"area":3}}' ELSE '{{}}' END AS args
FROM {events}""",
}


def x4_extract_fenced_calls(spark, sf_dir):
    return X.extract_fenced_calls(spark_input(spark, sf_dir, "fenced"), ["conv_id", "turn"], tag="call")


def x4_extract_bare_json(spark, sf_dir):
    return X.extract_fenced_calls(spark_input(spark, sf_dir, "fenced"), ["conv_id", "turn"], bare=True).select("conv_id", "turn", "block_pos", "raw_call", "valid")


def x5_extract_prompt_entities(spark, sf_dir):
    got = X.extract_prompt_entities(spark_input(spark, sf_dir, "prompts"))
    return got.select("home_id", "place", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("service_names", ",").alias("service_names"))


def x6_extract_provider_responses(spark, sf_dir):
    return X.extract_provider_responses(spark_input(spark, sf_dir, "response_log")).drop("body")


def x7_parse_sse_lines(spark, sf_dir):
    chunks, failures = X.parse_sse_lines(spark_input(spark, sf_dir, "sse"))
    return chunks.unionByName(failures, allowMissingColumns=True)


def x8_extract_structured_output(spark, sf_dir):
    checked = V.validate_tool_calls(spark_input(spark, sf_dir, "tasks"), V.intent_catalog(spark), args="tool_args")
    return X.extract_structured_output(checked, F.col("errors")).select("event_id", "method", "data", "error")


def j12_list_service_tools(spark, sf_dir):
    homes = spark_input(spark, sf_dir, "registry").select("home_id", F.when(F.col("place") == 7, "script").when(F.col("place") == 8, "camera").otherwise(F.col("domain")).alias("domain"))
    services = spark.createDataFrame([("light", "turn_on", ["rgb_color", "brightness", "effect"]), ("light", "blink", ["brightness"]), ("fan", "toggle", []),
                                      ("climate", "set_temperature", ["temperature", "hvac_mode", "target"]), ("camera", "turn_on", []), ("script", "turn_on", [])],
                                     "domain string, service string, fields array<string>")
    return V.list_service_tools(homes, F.broadcast(services)).select("home_id", "tool", F.array_join("arguments", ",").alias("arguments"))


def j13_validate_tool_calls(spark, sf_dir):
    checked = V.validate_tool_calls(spark_input(spark, sf_dir, "agent_calls"), V.intent_catalog(spark))
    return checked.select("event_id", "tool_name", "errors")


def j13_service_call_data(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "agent_calls").filter(F.col("tool_name") == fixed.SERVICE_TOOL)
    return rows.select("event_id", V.service_call_data(F.col("args")).alias("data"))


def j14_canonicalize_service_names(spark, sf_dir):
    names = spark.createDataFrame([("click", "toggle"), ("signup", "turn_on")], "hallucinated_service string, real_service string")
    rows = spark_input(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("service"))
    return V.canonicalize_service_names(rows, F.broadcast(names))


def j15_apply_model_rules(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "completions").select("conv_id", "turn", "model", F.when(F.col("turn") == 3, F.create_map(F.lit("top_k"), F.lit("5"))).alias("explicit"))
    got = V.apply_model_rules(rows)
    return got.select("conv_id", "turn", "model", "rule", F.array_join(F.sort_array(F.transform(F.map_entries("options"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("options"))


def j15_parse_by_model_rules(spark, sf_dir):
    """Completions parsed with the markers their model's rule names."""
    rules = [("zephyr", {"tool_call_prefix": "{\"name\"", "tool_call_suffix": "}"}), *fixed.MODEL_RULES]
    rows = V.apply_model_rules(spark_input(spark, sf_dir, "completions"), rules=rules)
    mark = lambda k: F.try_element_at("options", F.lit(k))
    got = C.extract_blocks(rows, tool=(mark("tool_call_prefix"), mark("tool_call_suffix")))
    return got.select("conv_id", "turn", F.array_join("raw_calls", "\n").alias("raw_calls"), "body")


def j15_apply_rule_table(spark, sf_dir):
    """A rule for every supplier, met by every customer's name."""
    suppliers = spark_input(spark, sf_dir, "supplier")
    rules = suppliers.select((-F.col("s_suppkey")).alias("pos"), F.col("s_suppkey").cast("string").alias("key"), F.explode(F.array(
        F.struct(F.lit("nation").alias("option"), F.col("s_nationkey").cast("string").alias("value")), F.struct(F.lit("top_k").alias("option"), F.col("s_suppkey").cast("string").alias("value")))).alias("o")).select("pos", "key", "o.*")
    names = spark_input(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("model"))
    got = V.apply_rule_table(names, rules, defaults={"top_k": "40", "top_p": "1"})
    return got.select("c_custkey", "rule", *[F.try_element_at("options", F.lit(k)).alias(k) for k in ("nation", "top_k", "top_p")])


def a12_join_schema_errors(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "part").withColumn("errors", F.filter(F.array(
        F.when(F.col("p_size") > 20, "size"), F.when(F.col("p_retailprice") > 1000, F.concat(F.lit("price of "), "p_name")), F.when(F.col("p_partkey") % 2 == 0, "even")), lambda e: e.isNotNull()))
    return rows.select("p_partkey", V.join_schema_errors(F.col("errors")).alias("message"))


def p24_flag_valid_hosts(spark, sf_dir):
    pages = spark_input(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))
    odd = F.element_at(F.array(*map(F.lit, ("10.0.0.1", "010.0.0.1", "-bad.example.com", "a_b.example.com", "localhost", "example", "x.y1"))), (F.col("page_id") % 7 + 1).cast("int"))
    return X.flag_valid_hosts(pages.unionByName(pages.select((-F.col("page_id") - 1).alias("page_id"), odd.alias("host"))))


def s11_skip_done_outputs(spark, sf_dir):
    work = spark_input(spark, sf_dir, "documents").select("doc_id", "lang")
    return V.skip_done_outputs(work, spark_input(spark, sf_dir, "labels"), ["doc_id"])


def s11_changed_parts(spark, sf_dir):
    """Words per document, kept by source and language: a first run before the last document's text was known, a second one after it."""
    docs = spark_input(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    last = docs.select(F.max("doc_id")).scalar()
    job = lambda rows: rows.select("doc_id", "source", "lang", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n_words"))
    kept = ChangedParts(spark, stage_dir(spark), ["source", "lang"])
    kept.update(docs.withColumn("text", F.when(F.col("doc_id") == last, F.concat("text", F.lit(" draft"))).otherwise(F.col("text"))), job)
    before = kept.read().select(F.max("run")).first()[0]
    kept.update(docs, job)
    return kept.read().select("doc_id", "source", "lang", "n_words", (F.col("run") != before).alias("again"))


QUERIES = {f.__name__: f for f in (
    x4_extract_fenced_calls, x4_extract_bare_json, x5_extract_prompt_entities, x6_extract_provider_responses, x7_parse_sse_lines, x8_extract_structured_output,
    j12_list_service_tools, j13_validate_tool_calls, j13_service_call_data, j14_canonicalize_service_names, j15_apply_model_rules, j15_parse_by_model_rules, j15_apply_rule_table,
    a12_join_schema_errors, p24_flag_valid_hosts, s11_skip_done_outputs, s11_changed_parts)}

_OBJ = lambda x: f"(json_valid({x}) AND starts_with(trim({x}), '{{') AND ends_with(trim({x}), '}}'))"
_opts = lambda d: "{" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
_rule_rows = ", ".join(f"({i}, '{k}')" for i, (k, _) in enumerate(fixed.MODEL_RULES))


def _option_sql():
    out = []
    for k, v in sorted(fixed.DEFAULT_OPTIONS.items()):
        cases = "".join(f" WHEN rule = '{r}' THEN '{d[k]}'" for r, d in fixed.MODEL_RULES if k in d)
        given = " WHEN turn = 3 THEN '5'" if k == "top_k" else ""
        out.append(f"'{k}=' || CASE{given}{cases} WHEN true THEN '{v}' END")
    return " || ',' || ".join(out)


ORACLES = {
    "x4_extract_fenced_calls": with_inputs("fenced") + f"""SELECT conv_id, turn, CAST(bp - 1 AS INT) AS block_pos, CAST(lp - 1 AS INT) AS line_pos, raw_call, {_OBJ("raw_call")} AS valid FROM (
      SELECT *, unnest(string_split(b, chr(10))) AS raw_call, generate_subscripts(string_split(b, chr(10)), 1) AS lp FROM (
        SELECT conv_id, turn, unnest(bs) AS b, generate_subscripts(bs, 1) AS bp FROM (SELECT *, regexp_extract_all(text, '```call\\n(.*?)```', 1, 's') AS bs FROM fenced))) WHERE raw_call <> ''""",
    "x4_extract_bare_json": with_inputs("fenced") + f"""SELECT conv_id, turn, CAST(bp - 1 AS INT) AS block_pos, raw_call, {_OBJ("raw_call")} AS valid FROM (
        SELECT conv_id, turn, unnest(bs) AS raw_call, generate_subscripts(bs, 1) AS bp FROM (SELECT *, regexp_extract_all(text, '(\\{{[\\S \\t]*?\\}})', 1) AS bs FROM fenced))""",
    "x5_extract_prompt_entities": with_inputs("prompts") + """SELECT home_id, place, array_to_string(regexp_extract_all(prompt, '\\b(\\w+\\.\\w+)\\s[''=]', 1), ',') AS entity_ids,
      array_to_string(regexp_extract_all(prompt, '\\b(\\w+\\.\\w+)\\([^)]*\\)', 1), ',') AS service_names FROM prompts""",
    "x6_extract_provider_responses": with_inputs("response_log") + """SELECT r.event_id, provider, CASE r.event_id % 10 WHEN 4 THEN 'missing or empty ''choices''' WHEN 7 THEN 'Response JSON is missing required keys: status, id'
        WHEN 8 THEN 'Response JSON error: ' || (body->>'$.error.message') END AS error,
      CASE r.event_id % 10 WHEN 0 THEN body->>'$.choices[0].message.content' WHEN 1 THEN body->>'$.choices[0].delta.content' WHEN 2 THEN '' WHEN 3 THEN body->>'$.choices[0].text'
        WHEN 5 THEN body->>'$.output[0].content[0].text' WHEN 6 THEN body->>'$.output[0].content[0].refusal' WHEN 9 THEN body->>'$.message.content' END AS content,
      CASE r.event_id % 10 WHEN 2 THEN '[' || json_extract(body, '$.choices[0].delta.tool_calls[0].function')::VARCHAR || ']' WHEN 9 THEN json_extract(body, '$.message.tool_calls')::VARCHAR END AS tool_calls,
      r.event_id % 10 IN (0, 6) AS unfinished FROM response_log r""",
    "x7_parse_sse_lines": with_inputs("sse") + """, t AS (SELECT stream_id, line_no, trim(line) AS x FROM sse), e AS (SELECT stream_id, min(line_no) FILTER (starts_with(x, 'error: ') OR contains(x, '[DONE]')) AS z FROM t GROUP BY 1)
      SELECT stream_id, line_no, CASE WHEN starts_with(x, 'data: ') THEN substr(x, 7) ELSE x END AS chunk, NULL AS error FROM t JOIN e USING (stream_id) WHERE (z IS NULL OR line_no < z) AND x <> ''
      UNION ALL SELECT stream_id, line_no, NULL, 'Error from server: ' || x FROM t JOIN e USING (stream_id) WHERE line_no = z AND starts_with(x, 'error: ')""",
    "x8_extract_structured_output": with_inputs("tasks") + f""", v AS (SELECT *, (tool_args::JSON->>'position')::INT AS p FROM tasks)
      SELECT event_id, method, CASE method WHEN 'none' THEN raw_text WHEN 'structure' THEN CASE WHEN json_valid(raw_text) THEN replace(raw_text, ': ', ':') END ELSE CASE WHEN p BETWEEN 0 AND 100 THEN tool_args END END AS data,
        CASE method WHEN 'structure' THEN CASE WHEN NOT json_valid(raw_text) THEN '{fixed.BAD_JSON_TEXT}' END WHEN 'tool' THEN CASE WHEN tool_args IS NULL THEN '{fixed.NO_TOOL_CALL_TEXT}'
          WHEN p IS NULL THEN '{fixed.SCHEMA_ERRORS_TEXT}expected string @ name; required key not provided @ position' WHEN p > 100 THEN '{fixed.SCHEMA_ERRORS_TEXT}value too large @ position' END END AS error FROM v""",
    "j12_list_service_tools": with_inputs("registry") + """, d AS (SELECT DISTINCT home_id, CASE place WHEN 7 THEN 'script' WHEN 8 THEN 'camera' ELSE domain END AS domain FROM registry)
      SELECT home_id, tool, arguments FROM d JOIN (VALUES ('light', 'light.turn_on', 'target_device,brightness,rgb_color'), ('fan', 'fan.toggle', 'target_device'), ('climate', 'climate.set_temperature', 'target_device,hvac_mode,temperature'),
        ('script', 'script.reload', 'target_device'), ('script', 'script.turn_on', 'target_device'), ('script', 'script.turn_off', 'target_device'), ('script', 'script.toggle', 'target_device')) v(domain, tool, arguments) USING (domain)""",
    "j13_validate_tool_calls": with_inputs("agent_calls") + """SELECT event_id, tool_name, CASE event_id % 6
       WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'expected integer @ position' WHEN (args->>'$.position')::INT > 100 THEN 'value too large @ position' END
       WHEN 1 THEN 'extra keys not allowed @ hue' || CASE WHEN (args->>'$.brightness')::INT > 100 THEN '; value too large @ brightness' ELSE '' END
       WHEN 2 THEN CASE WHEN event_id % 5 <> 0 THEN 'unknown service' END WHEN 3 THEN 'unknown tool' WHEN 4 THEN 'expected number @ volume_level' ELSE 'expected string @ area' END AS errors FROM agent_calls""",
    "j13_service_call_data": with_inputs("agent_calls") + """SELECT event_id, '{"brightness":' || (args->>'$.brightness') || ',"entity_id":"d"}' AS data FROM agent_calls WHERE event_id % 6 = 2""",
    "j14_canonicalize_service_names": "SELECT event_id, CASE event_type WHEN 'click' THEN 'toggle' WHEN 'signup' THEN 'turn_on' ELSE event_type END AS service FROM events",
    "j15_apply_model_rules": with_inputs("completions") + f""", r AS (SELECT conv_id, turn, model, (SELECT arg_min(k, i) FROM (VALUES {_rule_rows}) v(i, k) WHERE contains(lower(model), k)) AS rule FROM completions)
      SELECT conv_id, turn, model, rule, {_option_sql()} AS options FROM r""",
    "j15_parse_by_model_rules": with_inputs("completions") + """SELECT conv_id, turn, CASE WHEN contains(model, 'zephyr') THEN array_to_string(regexp_extract_all(completion, '\\{"name"(.*?)\\}', 1, 's'), chr(10))
        ELSE array_to_string(regexp_extract_all(completion, '<tool_call>(.*?)</tool_call>', 1, 's'), chr(10)) END AS raw_calls,
      regexp_replace(regexp_replace(completion, '<think>(.*?)</think>', '', 'gs'), CASE WHEN contains(model, 'zephyr') THEN '\\{"name"(.*?)\\}' ELSE '<tool_call>(.*?)</tool_call>' END, '', 'gs') AS body FROM completions""",
    "a12_join_schema_errors": """SELECT p_partkey, nullif(array_to_string(list_sort(list_filter([CASE WHEN p_size > 20 THEN 'size' END, CASE WHEN p_retailprice > 1000 THEN 'price of ' || p_name END, CASE WHEN p_partkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)), '; '), '') AS message FROM part""",
    "p24_flag_valid_hosts": f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages UNION ALL
        SELECT -page_id - 1, ['10.0.0.1', '010.0.0.1', '-bad.example.com', 'a_b.example.com', 'localhost', 'example', 'x.y1'][page_id % 7 + 1] FROM pages)
      SELECT page_id, host, host = 'localhost' OR regexp_matches(host, '{X.IPV4}') OR regexp_matches(host, '{X.HOST_NAME}') AS valid_host FROM h""",
    "j15_apply_rule_table": """WITH r AS (SELECT c_custkey, (SELECT max(s_suppkey) FROM supplier WHERE contains(lower(c_name), CAST(s_suppkey AS VARCHAR))) AS k FROM customer)
      SELECT c_custkey, CAST(k AS VARCHAR) AS rule, CAST(s_nationkey AS VARCHAR) AS nation, coalesce(CAST(k AS VARCHAR), '40') AS top_k, '1' AS top_p FROM r LEFT JOIN supplier ON s_suppkey = k""",
    "s11_changed_parts": r"""SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS INTEGER) AS n_words,
      (source, lang) IS NOT DISTINCT FROM (SELECT (source, lang) FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)) AS again FROM documents""",
    "s11_skip_done_outputs": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
ORACLES["x4_extract_bare_json"] = ORACLES["x4_extract_bare_json"].replace("{{", "{").replace("}}", "}").replace("\\{\\{", "\\{")
