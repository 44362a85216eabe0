"""Input tables derived from the given tables.

Each text is plain SQL that Spark and DuckDB read alike, so both sides of a check start from the
same rows. Braced names are tables: Spark gets DataFrames for them, DuckDB the views. Texts may
build on each other; DuckDB gets those as common table expressions.
"""
import re
from functools import reduce

Q = "chr(34)"  # a double quote inside SQL text

TEXTS = {
    # assistant turns wrapped as model completions, six shapes
    "completions": """
SELECT conv_id, turn,
       CASE conv_id % 4 WHEN 0 THEN 'Qwen3-4B' WHEN 1 THEN 'mistral-7b-instruct'
                        WHEN 2 THEN 'my-zephyr-mixtral' ELSE 'other' END AS model,
       (conv_id + turn) % 7 <> 0 AS has_api,
       (conv_id * 31 + turn) % 6 AS shape,
       CASE (conv_id * 31 + turn) % 6
         WHEN 0 THEN '<think>plan ' || CAST(turn AS STRING) || '</think>' || text
              || '<tool_call>{{"name": "light.turn_on", "arguments": {{"brightness": 0.5, "name": "lamp '
              || CAST(conv_id AS STRING) || '", "to_say": " acknowledged"}}}}</tool_call>'
         WHEN 1 THEN text || '<tool_call>{{"name": "set", "arguments": </tool_call> after'
         WHEN 2 THEN '<tool_call>{{"service": "light.turn_on", "target_device": "light.d'
              || CAST(conv_id AS STRING) || '", "rgb_color": "(' || CAST(turn AS STRING)
              || ', 2,30)", "brightness": 1}}</tool_call>' || text
         WHEN 3 THEN text || '<tool_call>call:TurnOn{{name:<escape>light.d' || CAST(conv_id AS STRING)
              || '<escape>,area:<escape>room ' || CAST(turn AS STRING) || '<escape>}}</tool_call>'
         WHEN 4 THEN text || '<tool_call>{{"name": "unclosed", "arguments": {{"k": ' || CAST(turn AS STRING) || '}}}}'
         ELSE '<think>a</think>x<think>b</think>' || text
              || '<tool_call>{{"arguments": "{{}}", "name": "first"}}</tool_call>mid<tool_call>{{"name": "second", "arguments": " "}}</tool_call>'
              || '<tool_call>{{"name": "third", "arguments": {{"z": true, "a": [1, 2], "n": null, "f": 2.0}}, "extra": 1}}</tool_call>'
       END AS completion
FROM {conversations} WHERE role = 'assistant'""",
    # expected calls as text, one message per event, grouped into examples by user and day
    "gold": """
SELECT user_id % 5 AS checkpoint, CASE user_id % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' ELSE 'm-xl' END AS model,
       CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS language,
       user_id * 100 + EXTRACT(day FROM ts) AS example_id, event_id, event_type,
       CAST(substr(props, 7, length(props) - 7) AS INT) AS k,
       CASE WHEN event_type = 'error' THEN 'Nothing to do.'
            WHEN event_type = 'purchase' THEN 'On it. <tool_call>{{"name": "HassLightSet", "arguments": {{"name": "lamp '
              || CAST(event_id % 3 AS STRING) || '", "rgb_color": [' || substr(props, 7, length(props) - 7) || ', 10, 20]}}}}</tool_call>'
            ELSE 'On it. <tool_call>{{"name": "' || event_type || '", "arguments": {{"k": ' || substr(props, 7, length(props) - 7)
              || ', "area": "a' || CAST(event_id % 2 AS STRING) || '"}}}}</tool_call>' END AS completion
FROM {events}""",
    # model answers: the expected calls with losses, changes and bad JSON mixed in
    "predicted": """
SELECT checkpoint, model, language, example_id, event_id,
       CASE WHEN (event_id * 7 + k) % 10 = 0 THEN 'I cannot do that.'
            WHEN event_type = 'error' AND (event_id * 7 + k) % 10 = 1 THEN '<tool_call>{{"name": "extra", "arguments": {{}}}}</tool_call>'
            WHEN event_type = 'error' THEN completion
            WHEN (event_id * 7 + k) % 10 = 1 THEN replace(completion, '"arguments"', '"arguments" oops')
            WHEN event_type = 'purchase' AND (event_id * 7 + k) % 10 IN (2, 3) THEN replace(completion, ', 10, 20]', ', 11, 21]')
            WHEN (event_id * 7 + k) % 10 = 2 THEN 'Sure.<think>hm</think><tool_call>{{"arguments": {{"area": "a'
              || CAST(event_id % 2 AS STRING) || '", "k": ' || CAST(k AS STRING) || '.0}}, "name": "' || event_type || '"}}</tool_call>'
            WHEN (event_id * 7 + k) % 10 = 3 THEN replace(completion, '"k": ', '"k": 1')
            ELSE completion END AS completion
FROM {gold}""",
    # chat log: user and assistant turns, calls on some assistant turns, a result row per call
    "log": """
SELECT conv_id, turn * 10 AS pos, role, text,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN 'call_tool_' || CAST(turn % 4 AS STRING) END AS call1_name,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN '{{"level":' || CAST(turn AS STRING) || ',"name":"lamp ' || CAST(conv_id AS STRING) || '"}}' END AS call1_args,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 1 THEN 'HassTurnOff' END AS call2_name,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 1 THEN '{{"name":"fan"}}' END AS call2_args,
       CAST(NULL AS STRING) AS tool_name, CAST(NULL AS STRING) AS tool_result
FROM {conversations}
UNION ALL
SELECT conv_id, turn * 10 + 1, 'tool_result', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       'call_tool_' || CAST(turn % 4 AS STRING), '{{"result":"Success"}}'
FROM {conversations} WHERE role = 'assistant' AND (conv_id + turn) % 3 <> 0
UNION ALL
SELECT conv_id, turn * 10 + 2, 'tool_result', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       'HassTurnOff', '{{"error":"no ' || CAST(turn AS STRING) || '"}}'
FROM {conversations} WHERE role = 'assistant' AND (conv_id + turn) % 3 = 1""",
    # entity registry of many homes, with aliases and the attributes of a few domains
    "registry": """
SELECT p_partkey, CAST(FLOOR(p_partkey / 40) AS BIGINT) AS home_id, p_partkey % 40 AS place,
       CASE p_partkey % 11 WHEN 0 THEN 'light' WHEN 1 THEN 'climate' WHEN 2 THEN 'media_player' WHEN 3 THEN 'switch' WHEN 4 THEN 'fan'
         WHEN 5 THEN 'blinds' WHEN 6 THEN 'garage_door' WHEN 7 THEN 'lock' WHEN 8 THEN 'vacuum' WHEN 9 THEN 'timer' ELSE 'todo' END AS domain,
       replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS suffix, p_name || ' ' || CAST(p_partkey AS STRING) AS friendly_name,
       CASE WHEN p_size % 2 = 0 THEN 'on' ELSE 'off' END AS state, p_partkey % 13 <> 0 AS exposed,
       p_partkey % 100 AS device_id, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size % 30 AS BIGINT) END AS entity_area,
       CASE WHEN p_partkey % 9 = 0 THEN 'W' END AS unit,
       CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS alias1, CASE WHEN p_partkey % 10 = 0 THEN 'my ' || p_type END AS alias2,
       CASE WHEN p_partkey % 11 = 0 AND p_size % 3 > 0 THEN p_size * 5 END AS red, p_partkey % 256 AS green, (p_partkey * 7) % 256 AS blue,
       CASE WHEN p_partkey % 11 = 0 THEN p_size * 5 END AS brightness,
       CASE WHEN p_partkey % 11 = 1 THEN CAST(p_size + 20 AS STRING) || '.5' END AS temperature,
       CASE WHEN p_partkey % 11 = 1 AND p_size % 5 = 0 THEN 'K' END AS temperature_unit,
       CASE WHEN p_partkey % 11 = 1 AND p_size % 2 = 0 THEN p_size END AS humidity,
       CASE WHEN p_partkey % 11 = 2 THEN p_name END AS media_title,
       CASE WHEN p_partkey % 11 = 2 THEN CAST(p_size AS DOUBLE) / CAST(100 AS DOUBLE) END AS volume_level
FROM {part}""",
    # device pile, with some devices of a type nobody supports
    "pile_devices": """
SELECT domain || '.' || suffix AS device_name, 'the ' || friendly_name AS description FROM (
  SELECT CASE p_partkey % 12 WHEN 0 THEN 'light' WHEN 1 THEN 'climate' WHEN 2 THEN 'media_player' WHEN 3 THEN 'switch' WHEN 4 THEN 'fan'
         WHEN 5 THEN 'blinds' WHEN 6 THEN 'garage_door' WHEN 7 THEN 'lock' WHEN 8 THEN 'vacuum' WHEN 9 THEN 'timer' WHEN 10 THEN 'todo' ELSE 'sensor' END AS domain,
       replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS suffix, p_name || ' ' || CAST(p_partkey AS STRING) AS friendly_name FROM {part}) t""",
    # the device piles of two languages; the second knows fewer devices, by other names
    "pile_devices_lang": """
SELECT language, device_name, CASE WHEN language = 'pl' THEN 'urządzenie ' || substr(description, 5) ELSE description END AS description
FROM {pile_devices}, (VALUES ('en'), ('pl')) AS l(language) WHERE language = 'en' OR length(device_name) % 3 > 0""",
    # one templated action per order
    "pile_templates": """
SELECT o_orderkey AS row_id, c_mktsegment AS persona, CASE WHEN o_orderkey % 4 = 0 THEN 'pl' ELSE 'en' END AS language, device_type, service, phrase,
       o_orderkey % 3 AS multiplier
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN (VALUES
 (0, 'light', 'turn_on', 'Turn on <device_name>'),
 (1, 'light', 'turn_on', 'Set <device_name> to <brightness> percent'),
 (2, 'light|fan', 'turn_off|turn_on', 'Turn off <device_name1> and start <device_name2>'),
 (3, 'climate', 'set_temperature', 'Set <device_name> to <temp_f> degrees'),
 (4, 'blinds|garage_door|lock', 'close_cover|open_cover|lock', 'Close <device_name1>, open <device_name2> and lock <device_name3>'),
 (5, 'light', 'turn_on', 'Make <device_name> <color>'),
 (6, 'timer', 'start', 'Start <device_name> for <duration>'),
 (7, 'todo', 'add_item', 'Add <todo> to <device_name>')) AS v(t, device_type, service, phrase) ON t = o_orderkey % 8""",
    # answer texts per service, persona and length; no todo.add_item, and no timer.start for one persona
    "pile_responses": """
SELECT language, service, persona, short, CASE WHEN language = 'pl' THEN 'Już: ' ELSE '' END || CASE WHEN short = 1 THEN 'Ok <device_name>' ELSE 'Right away, <device_name> it is' END || marker || ' (' || n_name || ')' AS response_starting,
       CASE WHEN language = 'pl' THEN 'Gotowe ' ELSE 'Done with ' END || '<device_name>' || marker || ' v' || CAST(n_nationkey AS STRING) AS response_confirmed
FROM (VALUES ('light.turn_on', ''), ('light.turn_on', ' <brightness>'), ('light.turn_on', ' <color>'), ('light.turn_off', ''), ('fan.turn_on', ''),
  ('climate.set_temperature', ' <temp_f>'), ('climate.set_temperature', ''), ('blinds.close_cover', ''), ('garage_door.open_cover', ''), ('lock.lock', ''), ('timer.start', ' <duration>')) AS v(service, marker),
  (SELECT DISTINCT c_mktsegment AS persona FROM {customer}) p, (VALUES (0), (1)) AS w(short), (VALUES ('en'), ('pl')) AS l(language), {nation}
WHERE (language = 'en' OR n_nationkey % 2 = 0) AND NOT (service = 'timer.start' AND persona = 'MACHINERY')""",
    # actions on a named device, one per customer
    "pile_actions": """
SELECT c_custkey AS row_id, c_mktsegment AS persona, 'en' AS language, service_name, 'unit_' || CAST(c_custkey AS STRING) AS device_name, phrase,
       CASE WHEN c_custkey % 10 = 0 THEN '{{"area": "n' || CAST(c_nationkey AS STRING) || '"}}' ELSE '' END AS arguments
FROM {customer} JOIN (VALUES (0, 'light.turn_off', 'Kill <device_name>'), (1, 'climate.set_temperature', 'Heat <device_name> to <temp_c>'),
  (2, 'lock.lock', 'Lock it up'), (3, 'fan.turn_on', 'Run <device_name>')) AS v(t, service_name, phrase) ON t = c_custkey % 4""",
    # state questions, one per order
    "pile_status": """
SELECT o_orderkey AS row_id, 'assistant' AS persona, 'en' AS language, device_type, state, phrase, assistant_response
FROM {orders} JOIN (VALUES (0, 'light', 'on;<color>;<brightness>%', 'How is <device_name>?', '<device_name> is <color> at <brightness>'),
  (1, 'climate', 'heat;<temp_f>F;<humidity>%', 'Temperature of <device_name>?', '<device_name>: <temp_f> at <humidity>'),
  (2, 'media_player', 'playing;<volume>', 'How loud is <device_name>?', '<device_name> at <volume>'),
  (3, 'timer', 'active;<remaining>', 'How long on <device_name>?', '<remaining> left'),
  (4, 'lock', 'locked', 'Is <device_name> locked?', 'Yes, <device_name> is')) AS v(t, device_type, state, phrase, assistant_response) ON t = o_orderkey % 5""",
    # failed calls, one per supplier
    "pile_failures": """
SELECT s_suppkey AS row_id, 'BUILDING' AS persona, 'en' AS language, service_name, split_part(service_name, '.', 1) || '.s' || CAST(s_suppkey AS STRING) AS correct_device_name, s_name AS correct_friendly_name,
       split_part(service_name, '.', 1) || '.bad_s' || CAST(s_suppkey AS STRING) AS bad_device_name, phrase, 'No <device_name>' AS error_result, 'Again: <device_name>' AS retry_prompt
FROM {supplier} JOIN (VALUES (0, 'light.turn_off', 'Stop <device_name>'), (1, 'climate.set_temperature', '<device_name> to <temp_f> please'), (2, 'lock.lock', 'Shut <device_name>')) AS v(t, service_name, phrase) ON t = s_suppkey % 3""",
    # refusals, one per customer
    "pile_refusals": """
SELECT c_custkey AS row_id, c_mktsegment AS persona, 'en' AS language, CASE c_custkey % 2 WHEN 0 THEN 'not_available' ELSE 'already_state' END AS reason_type,
       CASE c_custkey % 3 WHEN 0 THEN 'light.turn_on' WHEN 1 THEN 'vacuum.start' ELSE 'lock.lock' END AS service_name, 'r' || CAST(c_custkey AS STRING) AS device_name, c_name AS friendly_name,
       CASE WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 3 = 0 THEN 'on' WHEN c_custkey % 3 = 1 THEN 'cleaning' ELSE 'locked' END AS desired_state,
       'Handle <device_name>' AS phrase, 'Sorry, <device_name> needs nothing' AS response
FROM {customer}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(text):
    """Names a text reads, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(text)))


def spark_input(spark, sf_dir, name):
    """A derived or given table as a DataFrame."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    return spark.sql(text, **{n: spark_input(spark, sf_dir, n) for n in needs(text)})


def _collect(name, seen):
    if name in TEXTS and name not in seen:
        for n in needs(TEXTS[name]):
            _collect(n, seen)
        seen[name] = TEXTS[name].format(**{n: n for n in needs(TEXTS[name])})
    return seen


def with_inputs(*names, tail=""):
    """`WITH` clause that defines the derived tables for DuckDB; `tail` adds further definitions."""
    defs = reduce(lambda seen, n: _collect(n, seen), names, {})
    body = ",\n".join(f"{n} AS ({t})" for n, t in defs.items())
    return "WITH " + body + ((",\n" + tail) if tail else "") + "\n"
