"""Queries: conversation tables, API formats and chat rendering."""
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.operators import messages as M
from dialoom.operators import render as R
from dialoom.plans.inputs import spark_input, with_inputs

TOOLS_SHORT = " HassTurnOn(name,area), HassTurnOff(name),"
TOOLS_LISTED = "- HassTurnOn(name, area): Turns on a device\n- HassTurnOff(name): Turns off a device\n"
TOOLS_DECLARED = "<start_function_declaration>declaration:HassTurnOff{description:<escape>Off<escape>}<end_function_declaration>"


def log_messages(spark, sf_dir):
    """The chat log in the library's message shape."""
    log = spark_input(spark, sf_dir, "log")
    call = lambda i: F.struct(F.concat(F.lit("call_"), F.col("pos"), F.lit(f"_{i - 1}")).alias("id"),
                              F.col(f"call{i}_name").alias("name"), F.col(f"call{i}_args").alias("args"))
    at = F.col("pos") % 10
    return log.select("conv_id", "pos", "role", "text",
                      F.filter(F.array(call(1), call(2)), lambda c: c["name"].isNotNull()).alias("tool_calls"),
                      F.when(F.col("role") == "tool_result", F.concat(F.lit("call_"), F.col("pos") - at, F.lit("_"), at - 1)).alias("tool_call_id"),
                      "tool_name", "tool_result")


def w1_number_tool_calls(spark, sf_dir):
    """Ids are left out here so that every call is numbered."""
    log = log_messages(spark, sf_dir).withColumn("tool_calls", F.transform("tool_calls", lambda c: c.withField("id", F.lit(None).cast("string"))))
    return M.number_tool_calls(log)


def w2_trim_history(spark, sf_dir):
    return M.trim_history(log_messages(spark, sf_dir), 2).select("conv_id", "pos", "role", "text", "tool_result")


def w3_final_reply(spark, sf_dir):
    return M.final_reply(log_messages(spark, sf_dir))


def w4_request_text(spark, sf_dir):
    log = log_messages(spark, sf_dir)
    first = M.request_text(log, "first").withColumnRenamed("request", "first_request")
    return M.request_text(log).join(first, "conv_id")


def w7_iteration_budget(spark, sf_dir):
    log = log_messages(spark, sf_dir)
    free = M.iteration_budget(log, 0).select("conv_id", F.col("rounds").alias("rounds0"), F.col("error").alias("error0"))
    return M.iteration_budget(log, 2).join(free, "conv_id")


def x9_split_prompt_expected(spark, sf_dir):
    prompt, expected = M.split_prompt_expected(log_messages(spark, sf_dir))
    joined = M.join_pieces(prompt.withColumn("line", F.concat_ws(": ", "role", F.coalesce("text", "tool_result"))),
                             ["conv_id"], "pos", "line", "prompt", "\n")
    return joined.join(expected, "conv_id", "left")


def x9_split_marked_text(spark, sf_dir):
    """Rendered chats cut at the assistant marker."""
    texts = R.render_chat(log_messages(spark, sf_dir), "chatml")
    prompt, expected = M.split_marked_text(F.col("text"), "<|im_start|>assistant\n")
    return texts.select("conv_id", prompt.alias("prompt"), expected.alias("expected"))


def x13_to_openai_messages(spark, sf_dir):
    return M.to_openai_messages(log_messages(spark, sf_dir)).select("conv_id", "pos", "message")


def x13_to_openai_messages_parity(spark, sf_dir):
    return M.to_openai_messages(log_messages(spark, sf_dir), args_as_str=False, result_as_str=False, keep_plain=False,
                                content_as_list=True).select("conv_id", "pos", "message")


def x14_to_anthropic_messages(spark, sf_dir):
    system, rows = M.to_anthropic_messages(log_messages(spark, sf_dir))
    return rows.select("conv_id", "pos", "message").join(system, "conv_id")


def _tool_params(spark, sf_dir):
    """Tools and parameters derived from suppliers and nations."""
    return spark.sql("""SELECT 'svc_' || CAST(s_suppkey AS STRING) AS tool, 'Serves ' || s_name AS description,
      'p' || CAST(n_nationkey AS STRING) AS param, 'From ' || n_name AS param_description, n_nationkey AS param_pos,
      CASE n_nationkey % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'integer' ELSE 'string' END AS type, n_nationkey % 4 = 0 AS required
      FROM {s} JOIN {n} ON n_regionkey = s_suppkey % 5""", s=spark_input(spark, sf_dir, "supplier"), n=spark_input(spark, sf_dir, "nation"))


PARAMS_SQL = """WITH params AS (SELECT 'svc_' || s_suppkey AS tool, 'Serves ' || s_name AS description, 'p' || n_nationkey AS param,
  'From ' || n_name AS pd, n_nationkey AS o, CASE n_nationkey % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'integer' ELSE 'string' END AS type,
  n_nationkey % 4 = 0 AS required FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5)
"""


def x15_format_tools(spark, sf_dir):
    return R.format_tools(_tool_params(spark, sf_dir))


def x19_function_declarations(spark, sf_dir):
    return R.function_declarations(_tool_params(spark, sf_dir))


def _chat(style, tools=None, prompt=False):
    def query(spark, sf_dir):
        return R.render_chat(log_messages(spark, sf_dir), style, tools, prompt)
    return query


def x20_format_tool_results(spark, sf_dir):
    rows = log_messages(spark, sf_dir).filter(F.col("role") == "tool_result")
    gemma = M.format_tool_results(rows, "functiongemma").select("conv_id", "pos", F.col("item").alias("item_named"))
    return M.format_tool_results(rows).select("conv_id", "pos", "item").join(gemma, ["conv_id", "pos"])


def x21_training_mask(spark, sf_dir):
    pieces = R.render_pieces(log_messages(spark, sf_dir), "gemma3")
    return M.training_mask(pieces.withColumn("train_on_turn", F.col("role") == "assistant")) \
        .select("conv_id", "pos", "char_start", "char_end", "trainable")


def _examples(spark, sf_dir):
    return spark.sql("""SELECT o_orderkey AS example_id, 'You are ' || c_mktsegment AS prompt, 'please handle order ' || CAST(o_orderkey AS STRING) AS question,
      CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('answer', 'No ' || o_orderpriority, 'tool_calls', CAST(array() AS ARRAY<STRUCT<tool_name STRING, service_name STRING, args STRING>>),
             'results', CAST(array() AS ARRAY<STRUCT<tool_name STRING, tool_result STRING>>), 'train_on_turn', true))
        ELSE array(named_struct('answer', 'Trying', 'tool_calls', array(named_struct('tool_name', 'HassTurnOn', 'service_name', 'light.turn_on', 'args', '{{"name": "bad"}}'),
                named_struct('tool_name', 'HassTurnOff', 'service_name', 'fan.turn_off', 'args', '{{"name": "f"}}')),
             'results', CASE WHEN o_orderkey % 3 = 1 THEN array(named_struct('tool_name', 'HassTurnOn', 'tool_result', 'Err "' || o_orderstatus || '"')) ELSE CAST(array() AS ARRAY<STRUCT<tool_name STRING, tool_result STRING>>) END,
             'train_on_turn', o_orderkey % 3 <> 1),
           named_struct('answer', 'Again', 'tool_calls', array(named_struct('tool_name', 'HassTurnOn', 'service_name', 'light.turn_on', 'args', '{{"name": "' || o_orderstatus || '"}}')),
             'results', CAST(array() AS ARRAY<STRUCT<tool_name STRING, tool_result STRING>>), 'train_on_turn', true),
           named_struct('answer', 'Done', 'tool_calls', CAST(array() AS ARRAY<STRUCT<tool_name STRING, service_name STRING, args STRING>>),
             'results', CAST(array() AS ARRAY<STRUCT<tool_name STRING, tool_result STRING>>), 'train_on_turn', true)) END AS turns
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey""", orders=spark_input(spark, sf_dir, "orders"), customer=spark_input(spark, sf_dir, "customer"))


def a1_assemble_messages(spark, sf_dir):
    return M.assemble_messages(_examples(spark, sf_dir), instruction=F.lit("User instruction")).select("example_id", "messages")


def a1_assemble_messages_merged(spark, sf_dir):
    return M.assemble_messages(_examples(spark, sf_dir), system_role=False, service_names=True,
                               tool_format="functiongemma").select("example_id", "messages")


def p26_context_budget_flags(spark, sf_dir):
    limits = spark.createDataFrame([("en", 100), ("fr", 400), ("de", 2048)], "model string, context_length int")
    docs = spark_input(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), F.col("text").alias("prompt"))
    return M.context_budget_flags(docs, F.broadcast(limits)).select("doc_id", "model", "estimate", "too_long")


QUERIES = {f.__name__: f for f in (
    w1_number_tool_calls, w2_trim_history, w3_final_reply, w4_request_text, w7_iteration_budget, x9_split_prompt_expected,
    x9_split_marked_text, x13_to_openai_messages, x13_to_openai_messages_parity, x14_to_anthropic_messages, x15_format_tools)}
QUERIES |= {
    "x16_render_chatml": _chat("chatml"), "x16_render_chatml_tools": _chat("chatml", TOOLS_SHORT, True),
    "x17_render_zephyr": _chat("zephyr"), "x17_render_zephyr_legacy": _chat("zephyr_legacy", TOOLS_SHORT, True),
    "x18_render_gemma3": _chat("gemma3", TOOLS_LISTED), "x19_render_functiongemma": _chat("functiongemma", TOOLS_DECLARED, True),
}
QUERIES |= {f.__name__: f for f in (x19_function_declarations, x20_format_tool_results, x21_training_mask,
                                    a1_assemble_messages, a1_assemble_messages_merged, p26_context_budget_flags)}


def _q(text):
    return "'" + text.replace("'", "''") + "'"


LOG = """m AS (SELECT *, (call1_name IS NOT NULL)::INT + (call2_name IS NOT NULL)::INT AS nc,
  CASE WHEN role = 'tool_result' THEN 'call_' || (pos - pos % 10) || '_' || (pos % 10 - 1) END AS tcid,
  lag(role) OVER w AS prole, lead(role) OVER w AS nrole, lag(text) OVER w AS ptext, row_number() OVER w AS rn, lead(pos) OVER w AS npos, lag(pos, 2) OVER w AS pp
  FROM log WINDOW w AS (PARTITION BY conv_id ORDER BY pos))"""
CALLS = "c AS (SELECT conv_id, pos, 0 AS call_pos, call1_name AS tool_name, call1_args AS args FROM log WHERE call1_name IS NOT NULL UNION ALL SELECT conv_id, pos, 1, call2_name, call2_args FROM log WHERE call2_name IS NOT NULL)"
J = lambda x: f"to_json({x})::VARCHAR"


def _render_sql(expr, generation=""):
    return with_inputs("log", tail=LOG) + f"""SELECT conv_id,
      string_agg({expr}, '' ORDER BY pos) || {generation or "''"} AS text FROM m GROUP BY 1"""


def _chatml_sql(style, tools, generation):
    start, mid, end, ask = R.TURNS[style]
    s, e = _q(start), _q(end)
    call = lambda i: f"""'<tool_call>' || chr(10) || '{{"name": "' || call{i}_name || '", "arguments": ' || call{i}_args || '}}' || chr(10) || '</tool_call>'"""
    user = "user|>" if style == "zephyr" else "user"
    if tools is None:
        sysm = f"WHEN rn = 1 AND role = 'system' THEN {_q(start + 'system' + mid)} || text || {_q(chr(10) + fixed.NO_TOOLS_TEXT + end)}"
        lead = "''"
    else:
        sysm = "WHEN rn = 1 AND role = 'system' THEN ''"
        lead = f"""CASE WHEN rn = 1 THEN {_q(start + 'system' + mid)} || CASE WHEN role = 'system' THEN text || chr(10) || chr(10) ELSE '' END || {_q('Tools:' + chr(10) + tools + R.CALL_HELP + end)} ELSE '' END"""
    expr = f"""{lead} || CASE {sysm} WHEN role IN ('user','system') THEN {s} || role || {_q(mid)} || text || {e}
      WHEN role = 'assistant' THEN {s} || role || {_q(mid)} || text || CASE WHEN nc > 0 THEN chr(10) || {call(1)} ELSE '' END || CASE WHEN nc > 1 THEN chr(10) || {call(2)} ELSE '' END || {e}
      ELSE CASE WHEN prole = 'tool_result' THEN '' ELSE {_q(start + user)} END || chr(10) || '<tool_response>' || chr(10) || tool_result || chr(10) || '</tool_response>' || CASE WHEN nrole = 'tool_result' THEN '' ELSE {e} END END"""
    return _render_sql(expr, _q(ask) if generation else "")


def _legacy_sql():
    call = lambda i: f"""'{{"name": "' || call{i}_name || '", "arguments": ' || call{i}_args || '}}' || chr(10)"""
    expr = f"""'<|' || CASE role WHEN 'tool_result' THEN 'tool' ELSE role END || '|>' || chr(10) || coalesce(tool_result, text)
      || CASE role WHEN 'system' THEN {_q(chr(10) + 'Services:' + TOOLS_SHORT)} WHEN 'assistant' THEN CASE WHEN nc = 0 THEN chr(10) ELSE chr(10) || '```tool' || chr(10)
        || {call(1)} || CASE WHEN nc > 1 THEN {call(2)} ELSE '' END || '```' END ELSE '' END || '<|endoftext|>' || chr(10)"""
    return _render_sql(expr, "'<|assistant|>'")


def _gemma_sql():
    call = lambda i: f"""chr(10) || '<tool_call>{{"name": "' || call{i}_name || '", "arguments": ' || call{i}_args || '}}</tool_call>'"""
    expr = f"""CASE WHEN rn = 1 THEN {_q('Tools:' + chr(10) + TOOLS_LISTED)} ELSE '' END || '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'user' WHEN 'tool_result' THEN 'tool' ELSE role END || chr(10)
      || CASE WHEN role = 'tool_result' THEN '<tool_result>' || tool_result || '</tool_result>' ELSE trim(text, chr(32) || chr(10)) END
      || CASE WHEN nc > 0 THEN {call(1)} ELSE '' END || CASE WHEN nc > 1 THEN {call(2)} ELSE '' END || '<end_of_turn>' || chr(10)"""
    return expr


def _functiongemma_sql():
    esc = "'<escape>'"
    call1 = f"""'<start_function_call>call:' || call1_name || '{{level:' || (call1_args::JSON->>'level') || ',name:' || {esc} || (call1_args::JSON->>'name') || {esc} || '}}<end_function_call>'"""
    call2 = f"""'<start_function_call>call:HassTurnOff{{name:<escape>fan<escape>}}<end_function_call>'"""
    expr = f"""CASE WHEN rn = 1 THEN {_q('<start_of_turn>developer' + chr(10) + R.DEVELOPER_TOOLS + TOOLS_DECLARED + '<end_of_turn>' + chr(10))} ELSE '' END
      || CASE WHEN rn = 1 AND role = 'system' THEN ''
        WHEN role = 'tool_result' THEN '<start_function_response>response:' || tool_name || '{{' || (json_keys(tool_result)[1]) || ':<escape>' || json_extract_string(tool_result, '$.' || json_keys(tool_result)[1]) || '<escape>}}<end_function_response>'
        ELSE CASE WHEN coalesce(prole, '') = 'tool_result' THEN '' ELSE '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) END
          || CASE WHEN rn = 2 AND prole = 'system' THEN trim(ptext, chr(32) || chr(10)) || chr(10) ELSE '' END || trim(text, chr(32) || chr(10))
          || CASE WHEN nc > 0 THEN {call1} ELSE '' END || CASE WHEN nc > 1 THEN {call2} ELSE '' END
          || CASE WHEN nc > 0 THEN CASE WHEN npos IS NULL THEN '<start_function_response>' ELSE '' END ELSE '<end_of_turn>' || chr(10) END END"""
    return _render_sql(expr, "CASE WHEN max_by(role, pos) = 'tool_result' THEN '' ELSE '<start_of_turn>model' || chr(10) END")


def _openai_sql(as_str, keep, as_list):
    a = lambda i: J(f"call{i}_args") if as_str else f"call{i}_args"
    call = lambda i: f"""'{{"type":"function","id":"call_' || pos || '_{i - 1}","function":{{"arguments":' || {a(i)} || ',"name":' || {J(f"call{i}_name")} || '}}}}'"""
    user = f"""'[{{"type":"text","text":' || {J("text")} || '}}]'""" if as_list else J("text")
    res = J("tool_result") if as_str else f"""'{{"name":' || {J("tool_name")} || ',"response":{{"result":' || tool_result || '}}}}'"""
    return with_inputs("log", tail=LOG) + f"""SELECT conv_id, pos, CASE role WHEN 'system' THEN '{{"role":"system","content":' || {J("text")} || '}}'
      WHEN 'user' THEN '{{"role":"user","content":' || {user} || '}}'
      WHEN 'tool_result' THEN '{{"role":"tool","content":' || {res} || ',"tool_call_id":' || {J("tcid")} || '}}'
      ELSE '{{"role":"assistant","content":' || {J("text")} || CASE WHEN nc > 0 THEN ',"tool_calls":[' || {call(1)} || CASE WHEN nc > 1 THEN ',' || {call(2)} ELSE '' END || ']' ELSE '' END || '}}' END AS message
      FROM m {"" if keep else "WHERE role <> 'assistant' OR nc > 0"}"""


def _a1_sql(system, service, named, instruction):
    item = lambda t: f"""'[{{"type":"text","text":' || {J(t)} || '}}]'"""
    msg = lambda role, t, train: f"""'{{"role":"{role}","content":' || {item(t)} || ',"train_on_turn":' || {train} || '}}'"""
    on, off = ("'light.turn_on'", "'fan.turn_off'") if service else ("'HassTurnOn'", "'HassTurnOff'")
    prompt = "'You are ' || c_mktsegment" + (" || chr(10) || 'User instruction:'" if instruction else "")
    ask = "'please handle order ' || o_orderkey"
    if system:
        head = msg("system", prompt, "'false'") + " || ',' || " + msg("user", ask, "'false'")
    else:
        head = msg("user", f"{prompt} || chr(10) || {ask}", "'false'")
    fn = lambda n, a: f"""'{{"function":{{"name":' || {J(n)} || ',"arguments":' || {J(a)} || '}}}}'"""
    def said(text, train, calls):
        return f"""'{{"role":"assistant","content":' || {item(_q(text))} || ',"train_on_turn":' || {train} || ',"tool_calls":[' || {" || ',' || ".join(fn(*c) for c in calls)} || ']}}'"""
    def result(name, cid, value):
        if named:
            return f"""'{{"name":' || {J(name)} || ',"response":{{"result":' || {J(value)} || '}}}}'"""
        inner = f"""'{{"tool_name": ' || {J(name)} || ', "tool_call_id": "call_' || {cid} || '", "tool_result": ' || {J(value)} || '}}'"""
        return f"""'{{"type":"text","text":' || {J(inner)} || '}}'"""
    tool = lambda items: f"""'{{"role":"tool","content":[' || {items} || '],"train_on_turn":false}}'"""
    ok = "'Success'"
    first = said("Trying", "CASE WHEN o_orderkey % 3 = 1 THEN 'false' ELSE 'true' END", [(on, "'{\"name\": \"bad\"}'"), (off, "'{\"name\": \"f\"}'")])
    err = "'Err \"' || o_orderstatus || '\"'"
    items1 = f"""CASE WHEN o_orderkey % 3 = 1 THEN {result("'HassTurnOn'", "1", err)} ELSE {result(on, "1", ok)} || ',' || {result(off, "2", ok)} END"""
    again = said("Again", "'true'", [(on, "'{\"name\": \"' || o_orderstatus || '\"}'")])
    items2 = result(on, "CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 3 END", ok)
    return f"""SELECT o_orderkey AS example_id, '[' || {head} || ',' || CASE WHEN o_orderkey % 3 = 0 THEN {msg("assistant", "'No ' || o_orderpriority", "'true'")}
      ELSE {first} || ',' || {tool(items1)} || ',' || {again} || ',' || {tool(items2)} || ',' || {msg("assistant", "'Done'", "'true'")} END || ']' AS messages
      FROM orders JOIN customer ON o_custkey = c_custkey"""


ORACLES = {
    "w1_number_tool_calls": with_inputs("log", tail=CALLS) + """SELECT conv_id, pos, call_pos, tool_name, args,
      'call_' || row_number() OVER (PARTITION BY conv_id ORDER BY pos, call_pos) AS call_id FROM c""",
    "w2_trim_history": with_inputs("log") + """SELECT conv_id, pos, role, text, tool_result FROM log
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) = 1 OR row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= 4""",
    "w3_final_reply": with_inputs("log") + f"""SELECT conv_id, coalesce((SELECT arg_max(text, pos) FROM log y WHERE y.conv_id = x.conv_id AND role = 'assistant' AND text <> ''
      AND pos > (SELECT min(pos) FROM log z WHERE z.conv_id = x.conv_id)), {_q(fixed.NO_SPEECH_TEXT)}) AS reply FROM (SELECT DISTINCT conv_id FROM log) x""",
    "w4_request_text": with_inputs("log") + """SELECT conv_id, coalesce(arg_max(text, pos) FILTER (role = 'user'), arg_max(text, pos)) AS request,
      coalesce(arg_min(text, pos) FILTER (role = 'user'), arg_max(text, pos)) AS first_request FROM log GROUP BY 1""",
    "w7_iteration_budget": with_inputs("log", tail="""r AS (SELECT conv_id, pos, call1_name IS NOT NULL AS calling, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM log WHERE role = 'assistant'),
      s AS (SELECT conv_id, min(n) FILTER (NOT calling) AS stop, max(n) AS total FROM r GROUP BY 1)""") + f"""
      SELECT conv_id, least(coalesce(stop, total), 2) AS rounds, CASE WHEN coalesce(stop, total + 1) > 2 AND total >= 2 THEN {_q(fixed.OUT_OF_ATTEMPTS_TEXT)} END AS error,
      least(coalesce(stop, total), 1) AS rounds0, NULL::VARCHAR AS error0 FROM s""",
    "x9_split_prompt_expected": with_inputs("log") + """SELECT p.*, expected FROM (SELECT conv_id, string_agg(role || ': ' || coalesce(text, tool_result), chr(10) ORDER BY pos) AS prompt
      FROM log WHERE role <> 'assistant' GROUP BY 1) p LEFT JOIN (SELECT conv_id, arg_min(text, pos) AS expected FROM log WHERE role = 'assistant' GROUP BY 1) e USING (conv_id)""",
    "x9_split_marked_text": "SELECT conv_id, split_part(text, '<|im_start|>assistant' || chr(10), 1) || '<|im_start|>assistant' || chr(10) AS prompt, nullif(string_split(text, '<|im_start|>assistant' || chr(10))[2], NULL) AS expected FROM ("
      + _chatml_sql("chatml", None, False) + ")",
    "x13_to_openai_messages": _openai_sql(True, True, False),
    "x13_to_openai_messages_parity": _openai_sql(False, False, True),
    "x14_to_anthropic_messages": with_inputs("log", tail=LOG) + f"""SELECT conv_id, pos, coalesce((SELECT arg_max(text, pos) FROM log s WHERE s.conv_id = m.conv_id AND role = 'system'), '') AS system,
      '{{"role":"' || CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END || '","content":[' || CASE WHEN role = 'tool_result' THEN '{{"type":"tool_result","tool_use_id":' || {J("tcid")} || ',"content":' || {J("tool_result")} || '}}'
        ELSE '{{"type":"text","text":' || {J("text")} || '}}' || CASE WHEN nc > 0 THEN ',{{"type":"tool_use","id":"call_' || pos || '_0","name":' || {J("call1_name")} || ',"input":' || call1_args || '}}' ELSE '' END
          || CASE WHEN nc > 1 THEN ',{{"type":"tool_use","id":"call_' || pos || '_1","name":' || {J("call2_name")} || ',"input":' || call2_args || '}}' ELSE '' END END || ']}}' AS message
      FROM m WHERE role <> 'system'""".replace("{{", "{").replace("}}", "}"),
    "x15_format_tools": PARAMS_SQL + """SELECT tool, tool || '(' || string_agg(param, ',' ORDER BY o) || ')' AS minimal, '- ' || tool || '(' || string_agg(param, ', ' ORDER BY o) || '): ' || any_value(description) AS listed,
      '{"type":"function","function":{"name":"' || tool || '","description":"' || any_value(description) || '","parameters":{"type":"object","properties":{' || string_agg('"' || param || '":{"type":"' || type || '","description":"' || pd || '"}', ',' ORDER BY o)
      || '},"required":[' || coalesce(string_agg('"' || param || '"', ',' ORDER BY o) FILTER (required), '') || ']}}}' AS schema,
      '{"name":"' || tool || '","description":"' || any_value(description) || '","input_schema":{"type":"object","properties":{' || string_agg('"' || param || '":{"type":"' || type || '","description":"' || pd || '"}', ',' ORDER BY o)
      || '},"required":[' || coalesce(string_agg('"' || param || '"', ',' ORDER BY o) FILTER (required), '') || ']}}' AS input_schema FROM params GROUP BY tool""",
    "x16_render_chatml": _chatml_sql("chatml", None, False),
    "x16_render_chatml_tools": _chatml_sql("chatml", TOOLS_SHORT, True),
    "x17_render_zephyr": _chatml_sql("zephyr", None, False),
    "x17_render_zephyr_legacy": _legacy_sql(),
    "x18_render_gemma3": _render_sql(_gemma_sql()),
    "x19_render_functiongemma": _functiongemma_sql().replace("{{", "{").replace("}}", "}"),
    "x19_function_declarations": PARAMS_SQL + """SELECT tool, '<start_function_declaration>declaration:' || tool || '{description:<escape>' || any_value(description) || '<escape>,parameters:{properties:{'
      || string_agg(param || ':{description:<escape>' || pd || '<escape>' || CASE type WHEN 'array' THEN ',items:{type:<escape>STRING<escape>}' ELSE '' END || ',type:<escape>' || upper(type) || '<escape>}', ',' ORDER BY param) || '},'
      || coalesce('required:[' || string_agg('<escape>' || param || '<escape>', ',' ORDER BY o) FILTER (required) || '],', '') || 'type:<escape>OBJECT<escape>}}<end_function_declaration>' AS declaration FROM params GROUP BY tool""",
    "x20_format_tool_results": with_inputs("log", tail=LOG) + f"""SELECT conv_id, pos, '{{"type":"text","text":' || {J(f"'{{{{' || '\"tool_name\": ' || {J('tool_name')} || ', \"tool_call_id\": ' || {J('tcid')} || ', \"tool_result\": ' || {J('tool_result')} || '}}}}'")} || '}}' AS item,
      '{{"name":' || {J("tool_name")} || ',"response":{{"result":' || {J("tool_result")} || '}}' || '}}' AS item_named FROM m WHERE role = 'tool_result'""".replace("{{", "{").replace("}}", "}"),
    "x21_training_mask": with_inputs("log", tail=LOG + ", pieces AS (SELECT conv_id, pos, role, " + _gemma_sql().replace(_q("Tools:" + chr(10) + TOOLS_LISTED), _q(fixed.NO_TOOLS_TEXT)) + " AS piece FROM m)") + """
      SELECT conv_id, pos, CAST(sum(length(piece)) OVER w AS BIGINT) AS char_end, CAST(sum(length(piece)) OVER w - length(piece) AS BIGINT) AS char_start, role = 'assistant' AS trainable
      FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY pos)""",
    "a1_assemble_messages": _a1_sql(True, False, False, True),
    "a1_assemble_messages_merged": _a1_sql(False, True, True, False),
    "p26_context_budget_flags": """SELECT doc_id, lang AS model, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.5) AS BIGINT) AS estimate,
      coalesce(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.5) > context_length, false) AS too_long
      FROM documents LEFT JOIN (VALUES ('en', 100), ('fr', 400), ('de', 2048)) v(l, context_length) ON l = lang""",
}
