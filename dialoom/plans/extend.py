"""Queries: growing and translating piles, in-context examples, files."""
import hashlib
import json

from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.stage import stage, stage_dir
from dialoom.operators import extend as E
from dialoom.operators import messages as M
from dialoom.operators import sampling as S
from dialoom.plans.generate import H, L
from dialoom.plans.inputs import TEXTS, spark_input, with_inputs
from dialoom.plans.messages import _a1_sql, _examples
from dialoom.sources import piles as P
from dialoom.sources import sft

NL = "chr(10)"
TEXTS |= {
    # raw answers of an outside model about device contexts
    "answers": f"""
SELECT p_partkey, 'the ' || p_name || ' ' || CAST(p_partkey AS STRING) AS description,
  CASE p_partkey % 6
    WHEN 0 THEN '```json' || {NL} || '{{{{"phrase": "Stop The ' || upper(p_name) || ' ' || CAST(p_partkey AS STRING) || ' now", "response": "no"}}}}' || {NL} || '```'
    WHEN 1 THEN 'Sure: {{{{"phrase": "Stop <device_name>", "response": " "}}}} ok'
    WHEN 2 THEN 'no json here at all'
    WHEN 3 THEN '"{{{{"phrase": "nothing named", "response": "x"}}}}"'
    WHEN 4 THEN '{{{{"phrase": "broken, "response": }}}}'
    ELSE '{{{{"phrase": " Use <device_name> ", "response": "yes ' || p_brand || '"}}}}' END AS answer
FROM {{part}}""",
    "services": """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'light.turn_on' WHEN 1 THEN 'vacuum.start' WHEN 2 THEN 'climate.set_temperature' WHEN 3 THEN 'garage_door.open_cover'
  WHEN 4 THEN 'media_player.media_play_pause' WHEN 5 THEN 'todo.add_item' ELSE 'lock.lock' END AS service_name, CASE WHEN o_orderkey % 3 = 0 THEN '{{"k": ' || CAST(o_custkey AS STRING) || '}}' ELSE '{{}}' END AS service_data
FROM {orders}""",
    # phrases with markers, and translations that reorder words and translate marker names
    "phrases": """
SELECT o_orderkey, 'light.lamp of ' || o_orderpriority AS device, 'Set <device_name> to <brightness> for ' || o_orderpriority AS phrase, o_orderstatus AS kept FROM {orders}""",
    "translations": """
SELECT DISTINCT 'Set <device_name> to <brightness> for ' || o_orderpriority AS source, 'Stelle <geraet> auf <helligkeit> fuer ' || o_orderpriority AS translated FROM {orders}
UNION ALL SELECT DISTINCT 'lamp of ' || o_orderpriority, 'Lampe-von ' || o_orderpriority FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "icl": """
SELECT * FROM (VALUES ('light', 'Turn on <name> in <area>', 'HassTurnOn', 'On in <area>'), ('light', 'Dim <name> to <brightness>', 'HassLightSet', 'Dimmed <name>'), ('light', 'Paint <name> <color>', 'HassLightSet', 'Now <color>'),
 ('fan', 'Run <name>', 'HassTurnOn', 'Running'), ('switch', 'Flip <name>', 'HassToggle', 'Flipped <name>'), ('lock', 'Lock <name>', 'HassTurnOn', 'Locked'), ('cover', 'Close <name>', 'HassTurnOff', 'Closed')) AS v(type, request, tool, response)""",
}


def p1_filter_supported_domains(spark, sf_dir):
    devices = E.filter_supported_domains(spark_input(spark, sf_dir, "pile_devices"), "device_name").select(F.col("device_name").alias("value"))
    templates = E.filter_supported_domains(spark_input(spark, sf_dir, "pile_templates"), "device_type", ["light", "fan"])
    return devices.unionByName(templates.select(F.concat_ws(" ", "row_id", "device_type").alias("value")))


def p17_desired_state(spark, sf_dir):
    return spark_input(spark, sf_dir, "services").select("o_orderkey", E.desired_state(F.col("service_name")).alias("state"))


def p18_describe_service(spark, sf_dir):
    return spark_input(spark, sf_dir, "services").select("o_orderkey", E.describe_service(F.col("service_name"), F.col("service_data")).alias("text"))


def p19_clean_completion_text(spark, sf_dir):
    return spark_input(spark, sf_dir, "answers").select("p_partkey", E.strip_quotes(F.col("answer")).alias("unquoted"), E.strip_code_fence(F.col("answer")).alias("unfenced"))


def p20_extract_json_object(spark, sf_dir):
    return spark_input(spark, sf_dir, "answers").select("p_partkey", E.extract_json_object(F.col("answer")).alias("json"))


def p21_templatize_phrase(spark, sf_dir):
    return spark_input(spark, sf_dir, "answers").select("p_partkey", E.templatize_phrase(F.col("answer"), F.col("description")).alias("phrase"))


def p22_parse_tagged_lines(spark, sf_dir):
    rows = spark.sql("SELECT o_orderkey, concat_ws(chr(10), 'NORMAL: Ok ' || o_orderpriority, 'other', ' SHORT:Yes', 'SHORT: ', CASE WHEN o_orderkey % 2 = 0 THEN 'NORMAL:two' END) AS completion FROM {o}", o=spark_input(spark, sf_dir, "orders"))
    return E.parse_tagged_lines(rows, ["o_orderkey"])


def x11_build_generation_prompts(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "services").withColumns({"description": F.concat(F.lit("Unit "), "o_orderkey"), "device_name": F.concat(F.lit("d."), "o_orderkey"), "attribute": F.lit("state")})
    kinds = ["phrase", "status", "failed", "not_available", "already_state"]
    return S.union_languages(*[E.build_generation_prompts(rows, k, F.lit("german")).select("o_orderkey", F.lit(k).alias("kind"), "prompt") for k in kinds])


def x12_check_generated_rows(spark, sf_dir):
    good, bad = E.check_generated_rows(spark_input(spark, sf_dir, "answers"), ["phrase", "response"], placeholder_in="phrase")
    return good.select("p_partkey", "phrase", "response").unionByName(bad.select("p_partkey", "reason"), allowMissingColumns=True)


def x12_match_error(spark, sf_dir):
    return spark_input(spark, sf_dir, "part").select("p_partkey", E.match_error(F.col("p_name")).alias("error_result"))


def _answerer():
    """A stand-in for an outside model: it answers from the prompt's text, and only at the second try for some."""
    def complete(talks):
        import json
        out = []
        for talk in talks:
            text = talk[0]["content"].rsplit("What it said: ", 1)[-1].split("\n")[0]
            if "fail" in text:
                out.append("not json")
            elif text.endswith("2") and len(talk) == 1:
                out.append('{"response_starting": "only one"}')
            else:
                out.append(json.dumps({"response_starting": "Starting: " + text, "response_confirmed": "Done: " + text}))
        return out
    return complete


def x10_complete_batch(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" "), F.col("user_id") % 5).alias("prompt"))
    rows = rows.withColumn("prompt", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("fail "), "prompt")).otherwise(F.col("prompt")))
    return E.complete_batch(rows, _answerer(), required=("response_starting", "response_confirmed"), max_attempts=2)


def g8_split_responses(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "customer").select(F.concat(F.lit("svc."), F.col("c_nationkey") % 3).alias("service"), F.when(F.col("c_custkey") % 8 == 0, F.concat(F.lit("fail "), "c_name")).otherwise(F.col("c_name")).alias("response"),
                                                         F.col("c_mktsegment").alias("persona"), (F.col("c_custkey") % 2).cast("int").alias("short"))
    people = spark.createDataFrame([("assistant", "You help"), ("BUILDING", "You build")], "persona string, prompt string")
    return E.split_responses(rows, people, _answerer())


def g7_extend_persona(spark, sf_dir):
    def complete(talks):
        svc = [t[0]["content"].split("the service '")[1].split("'")[0] for t in talks]
        return [f"NORMAL: Aye, {s}\nSHORT: Aye\nNORMAL: \nnoise" for s in svc]
    return E.extend_persona(spark_input(spark, sf_dir, "pile_responses"), F.lit("pirate"), F.lit("salty"), complete)


def j16_translate_piles(spark, sf_dir):
    return E.translate_piles(spark_input(spark, sf_dir, "phrases"), ["phrase", "device"], spark_input(spark, sf_dir, "translations"), device_column="device") \
        .withColumn("untranslated", F.array_join("untranslated", ","))


def j16_distinct_phrases(spark, sf_dir):
    return E.distinct_phrases(spark_input(spark, sf_dir, "phrases"), ["phrase", "device"], device_column="device")


def j9_pick_icl_examples(spark, sf_dir):
    homes = spark_input(spark, sf_dir, "registry").select("home_id", F.concat_ws(".", "domain", "suffix").alias("entity_id"))
    return E.pick_icl_examples(homes, spark_input(spark, sf_dir, "icl"), 4, 42, F.array(*map(F.lit, ("Attic", "Hall", "Den"))))


def j9_pick_eval_icl_examples(spark, sf_dir):
    prompts = spark_input(spark, sf_dir, "registry").groupBy(F.col("home_id").alias("prompt_id")).agg(
        F.collect_set(F.concat_ws(".", "domain", "suffix")).alias("entity_ids"), F.collect_set(F.when(F.col("home_id") % 2 == 0, F.concat("domain", F.lit(".turn_on"))).otherwise("none.none")).alias("service_names"))
    examples = spark.createDataFrame([("light.turn_on", "lit"), ("fan.turn_on", "fanned"), ("light.turn_off", "dark"), ("door.open", "ajar")], "service string, response string")
    return E.pick_eval_icl_examples(prompts, examples, 2, 42)


def s1_read_pile(spark, sf_dir):
    """Device and action piles written as CSV per language, then read back."""
    root = stage_dir(spark)
    rows = spark_input(spark, sf_dir, "part").select(F.concat(F.lit("light."), "p_partkey").alias("device_name"), F.concat(F.lit('a "b", '), "p_name").alias("description"),
                                                     F.when(F.col("p_partkey") % 3 == 0, "polish").otherwise("english").alias("lang"))
    for lang in ("polish", "english"):  # the Polish file has its columns the other way round, and one more
        own = rows.filter(F.col("lang") == lang)
        own = own.select("device_name", "description") if lang == "english" else own.select(F.lit("x").alias("note"), "description", "device_name")
        own.write.csv(f"{root}/{lang}/pile_of_device_names.csv", header=True, quote='"', escape='"')
    return P.read_pile(spark, root, "device_names")


def s2_read_lines(spark, sf_dir):
    """Media names of two languages; every language uses the English ones."""
    root = stage_dir(spark)
    names = spark_input(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit("\t")).alias("value"), "p_partkey")
    for lang, rest in (("polish", 0), ("english", 1)):
        names.filter(F.col("p_partkey") % 2 == rest).select("value").write.text(f"{root}/{lang}/pile_of_media_names.txt")
    return P.read_lines(spark, root, "pile_of_media_names.txt").withColumn("media", F.lit(False)) \
        .unionByName(P.read_media_names(spark, root).withColumn("media", F.lit(True)))


def s3_read_optional_pile(spark, sf_dir):
    """Refusals written for one language, read by name; a pile no language has is empty."""
    root = stage_dir(spark)
    spark_input(spark, sf_dir, "pile_refusals").select(*P.PILES["refusals"].split(" ")).write.csv(f"{root}/english/pile_of_refusals.csv", header=True, quote='"', escape='"')
    return P.read_optional_pile(spark, root, "refusals").join(P.read_optional_pile(spark, root, "responses").select("service"), F.lit(False), "left")


def s4_read_icl_examples(spark, sf_dir):
    path = stage_dir(spark)
    spark_input(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(""), F.lit("")).alias("request"), F.lit("light").alias("type"), F.col("p_name").alias("response"), F.col("p_brand").alias("tool")) \
        .write.csv(path, header=True, quote='"', escape='"')
    return P.read_icl_examples(spark, path)


def s5_s6_sft_jsonl(spark, sf_dir):
    """Entries written as JSON lines and read back as message rows."""
    path = stage_dir(spark)
    sft.write_sft_jsonl(M.assemble_messages(_examples(spark, sf_dir), instruction=F.lit("User instruction")), path)
    return sft.read_sft_jsonl(spark, path).select(F.col("example_id").cast("bigint").alias("example_id"), F.col("pos").cast("bigint").alias("pos"), "role", "text")


def s7_append_pile(spark, sf_dir):
    """Appended, evolved and read through the pile's log; the doubled batch and the empty one leave nothing."""
    root, names = stage_dir(spark), ["doc_id", "source", "n_chars"]
    rows = spark_input(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    P.append_pile(rows.drop("n_chars"), root, "documents", "first")
    P.append_pile(rows.filter("lang = 'fr'"), root, "documents", "second")
    P.append_pile(rows.filter("lang = 'fr'"), root, "documents", "second")
    P.append_pile(rows.filter("lang = 'none'"), root, "documents")
    got = P.read_pile(spark, root, "documents", names)
    return got.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("n_chars").cast("bigint").alias("n_chars"))


def w14_accept_until(spark, sf_dir):
    """30 accepted answers per language from a stand-in model that answers some prompts with nothing useful."""
    from dialoom.operators.accept import accept_until

    def model(talks):
        out = []
        for talk in talks:
            h = int(hashlib.md5(talk[-1]["content"].encode()).hexdigest()[:8], 16)
            out.append(json.dumps({"phrase": f"phrase {h}"}) if h % 4 == 0 else "no JSON" if h % 4 == 1 else '{"phrase": " "}' if h % 4 == 2 else '{"other": 1}')
        return out

    def generate(rows):
        asked = E.complete_batch(rows.withColumn("prompt", F.concat(F.lit("document "), "doc_id")), model, max_attempts=1)
        return E.check_generated_rows(asked, ["phrase"])[0].select("doc_id", "phrase")

    docs = spark_input(spark, sf_dir, "documents").select("doc_id", "lang")
    return accept_until(docs, generate, 30, 42, ["doc_id"], ["lang"]).rows


def s8_evolve_pile_schema(spark, sf_dir):
    old = spark_input(spark, sf_dir, "pile_actions").select("row_id", "service_name", "phrase")
    new = spark_input(spark, sf_dir, "pile_actions").select("row_id", "service_name", "phrase", "arguments")
    return P.evolve_pile_schema(P.evolve_pile_schema(old, new), new.filter(F.lit(False)))


def s9_write_eval_report(spark, sf_dir):
    from dialoom.operators.scoring import accuracy_report, classify_failures
    from dialoom.plans.scoring import scored
    path = stage_dir(spark)
    rows = stage(scored(spark, sf_dir))  # read by the report and by the failures
    sft.write_eval_report(accuracy_report(rows), classify_failures(rows, ["example_id"]), path)
    return spark.read.schema("example_id bigint, failure string, n bigint").json(f"{path}/failures")


def s10_load_images_base64(spark, sf_dir):
    """Pages written as files of some dozens each, which count as images here."""
    path = stage_dir(spark)
    spark_input(spark, sf_dir, "pages").select("html").write.option("maxRecordsPerFile", 50).text(path)
    kinds = spark.createDataFrame([("txt", "image/x-page")], "extension string, mime_type string")
    good, bad = sft.load_images_base64(spark, path, kinds)
    return good.select("mime_type", F.md5(F.unbase64("data")).alias("digest")).unionByName(bad.select("mime_type", F.lit(None).cast("string").alias("digest")))


QUERIES = {f.__name__: f for f in (
    p1_filter_supported_domains, p17_desired_state, p18_describe_service, p19_clean_completion_text, p20_extract_json_object, p21_templatize_phrase,
    p22_parse_tagged_lines, x10_complete_batch, x11_build_generation_prompts, x12_check_generated_rows, x12_match_error, g7_extend_persona, g8_split_responses,
    j9_pick_icl_examples, j9_pick_eval_icl_examples, j16_translate_piles, j16_distinct_phrases, s1_read_pile, s2_read_lines, s3_read_optional_pile, s4_read_icl_examples, s5_s6_sft_jsonl, s7_append_pile, w14_accept_until,
    s8_evolve_pile_schema, s9_write_eval_report, s10_load_images_base64)}

_map = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
_ACTION = "split_part(service_name, '.', 2)"
_STATE = f"coalesce({_map(_ACTION, fixed.ACTION_STATES)}, {_map('service_name', fixed.SERVICE_STATES)}, '')"
_DESCRIBE = f"replace({_ACTION}, '_', ' ') || ' the ' || split_part(service_name, '.', 1) || CASE WHEN service_data = '{{}}' THEN '' ELSE ' with arguments ' || service_data END"
_UNFENCED = "CASE WHEN starts_with(answer, '```') AND ends_with(answer, '```') THEN array_to_string(list_filter(string_split(answer, chr(10)), lambda x: NOT starts_with(x, '```')), chr(10)) ELSE answer END"
_SNIP = f"regexp_extract({_UNFENCED}, '(?s)(\\{{.*\\}})', 1)"
_JSON = f"CASE WHEN {_SNIP} <> '' AND json_valid({_SNIP}) THEN {_SNIP} END"
_TEMPL = lambda t: f"CASE WHEN contains({t}, '<device_name>') OR strpos(lower({t}), lower(description)) = 0 THEN {t} ELSE substr({t}, 1, strpos(lower({t}), lower(description)) - 1) || '<device_name>' || substr({t}, strpos(lower({t}), lower(description)) + length(description)) END"


def _fmt(text, **kv):
    out = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in kv.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


_who = dict(language="'german'", name="'Unit ' || o_orderkey", device="'d.' || o_orderkey")
_lost = "'No device of that name is to be found in this home.'"
_COLORS_SORTED = L([c[1] for c in fixed.color_rows()])
_ik = ("home_id", "type", "request")
_stub_sql = lambda t, k: f"CASE WHEN contains({t}, 'fail') THEN {t} ELSE '{k}: ' || {t} END"
ORACLES = {
    "p1_filter_supported_domains": with_inputs("pile_devices", "pile_templates") + "SELECT device_name AS value FROM pile_devices WHERE NOT starts_with(device_name, 'sensor') UNION ALL SELECT row_id || ' ' || device_type FROM pile_templates WHERE device_type IN ('light', 'light|fan')",
    "p17_desired_state": with_inputs("services") + f"SELECT o_orderkey, {_STATE} AS state FROM services",
    "p18_describe_service": with_inputs("services") + f"SELECT o_orderkey, {_DESCRIBE} AS text FROM services",
    "p19_clean_completion_text": with_inputs("answers") + f"SELECT p_partkey, CASE WHEN starts_with(answer, '\"') AND ends_with(answer, '\"') THEN substr(answer, 2, length(answer) - 2) ELSE answer END AS unquoted, {_UNFENCED} AS unfenced FROM answers",
    "p20_extract_json_object": with_inputs("answers") + f"SELECT p_partkey, {_JSON} AS json FROM answers",
    "p21_templatize_phrase": with_inputs("answers") + f"SELECT p_partkey, {_TEMPL('answer')} AS phrase FROM answers",
    "p22_parse_tagged_lines": """SELECT o_orderkey, CAST(0 AS INT) AS line_pos, 0 AS short, 'Ok ' || o_orderpriority AS response FROM orders UNION ALL SELECT o_orderkey, 2, 1, 'Yes' FROM orders
      UNION ALL SELECT o_orderkey, 4, 0, 'two' FROM orders WHERE o_orderkey % 2 = 0""",
    "x10_complete_batch": """WITH q AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'fail ' ELSE '' END || event_type || ' ' || (user_id % 5) AS prompt FROM events)
      SELECT event_id, prompt, CASE WHEN event_id % 9 <> 0 THEN '{"response_starting": "Starting: ' || prompt || '", "response_confirmed": "Done: ' || prompt || '"}' END AS answer,
        CASE WHEN event_id % 9 = 0 OR ends_with(prompt, '2') THEN 2 ELSE 1 END AS attempts, CASE WHEN event_id % 9 = 0 THEN 'invalid JSON' END AS error FROM q""",
    "x11_build_generation_prompts": with_inputs("services") + " UNION ALL ".join([
        f"SELECT o_orderkey, 'phrase' AS kind, {_fmt(E.PHRASE_TEXT, service='service_name', data='service_data', **_who)} AS prompt FROM services",
        f"SELECT o_orderkey, 'status', {_fmt(E.STATUS_TEXT, attribute=chr(39) + 'state' + chr(39), **_who)} FROM services",
        f"SELECT o_orderkey, 'failed', {_fmt(E.FAILED_TEXT, service='service_name', action=_DESCRIBE, **_who)} || CASE WHEN service_name = 'climate.set_temperature' THEN {_fmt(E.TEMPERATURE_RULE)} ELSE '' END FROM services",
        f"SELECT o_orderkey, 'not_available', {_fmt(E.REFUSAL_TEXT, language=_who['language'], service='service_name', action=_DESCRIBE, reason=_lost)} FROM services",
        f"SELECT o_orderkey, 'already_state', {_fmt(E.REFUSAL_TEXT, language=_who['language'], service='service_name', action=_DESCRIBE, reason=f'CASE WHEN {_STATE} = {chr(39)*2} THEN {_lost} ELSE {chr(39)}The device is {chr(39)} || {_STATE} || {chr(39)} as it is, so there is nothing to do.{chr(39)} END')} FROM services"]),
    "x12_check_generated_rows": with_inputs("answers") + f""", j AS (SELECT *, {_JSON} AS j FROM answers), f AS (SELECT *, trim(coalesce(j->>'$.phrase', '')) AS p0, trim(coalesce(j->>'$.response', '')) AS r FROM j), t AS (SELECT *, {_TEMPL('p0')} AS p FROM f),
      c AS (SELECT *, CASE WHEN j IS NULL THEN 'no JSON object' WHEN p = '' OR r = '' THEN 'blank: ' || concat_ws(',', CASE WHEN p = '' THEN 'phrase' END, CASE WHEN r = '' THEN 'response' END) WHEN NOT contains(p, '<device_name>') THEN 'no placeholder' END AS reason FROM t)
      SELECT p_partkey, CASE WHEN reason IS NULL THEN p END AS phrase, CASE WHEN reason IS NULL THEN r END AS response, reason FROM c""",
    "x12_match_error": f"SELECT p_partkey, {_fmt(fixed.MATCH_ERROR, bad='p_name')} AS error_result FROM part",
    "g7_extend_persona": with_inputs("pile_responses") + """SELECT service, 'pirate' AS persona, response, short, line_pos FROM (SELECT DISTINCT service FROM pile_responses) s, LATERAL (SELECT 'Aye, ' || service AS response, 0 AS short, 0 AS line_pos UNION ALL SELECT 'Aye', 1, 1) v""",
    "g8_split_responses": f"""WITH q AS (SELECT 'svc.' || (c_nationkey % 3) AS service, CASE WHEN c_custkey % 8 = 0 THEN 'fail ' ELSE '' END || c_name AS response, c_mktsegment AS persona, CAST(c_custkey % 2 AS INT) AS short FROM customer)
      SELECT service, {_stub_sql('response', 'Starting')} AS response_starting, {_stub_sql('response', 'Done')} AS response_confirmed, persona, short FROM q""",
    "j9_pick_icl_examples": with_inputs("registry", "icl") + f""", d AS (SELECT home_id, domain AS type, arg_min(domain || '.' || suffix, {H('icl:device', 'home_id', "domain || '.' || suffix")}) AS dev FROM registry GROUP BY 1, 2),
      p AS (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY {H('icl:order', *_ik)}, request) AS place, {L(['Attic', 'Hall', 'Den'])}[{H('icl:area', *_ik)} % 3 + 1] AS ar, (({H('icl:brightness', *_ik)} % 101) / 100.0::DOUBLE)::VARCHAR AS br,
        {_COLORS_SORTED}[{H('icl:color', *_ik)} % 147 + 1] AS co FROM d JOIN icl USING (type))
      SELECT home_id, CAST(place AS INT) AS place, replace(replace(replace(replace(request, '<area>', ar), '<name>', dev), '<brightness>', br), '<color>', co) AS request,
        replace(replace(replace(replace(response, '<area>', CASE WHEN contains(request, '<area>') THEN ar ELSE '<area>' END), '<name>', CASE WHEN contains(request, '<name>') THEN dev ELSE '<name>' END), '<brightness>', br), '<color>', co) AS response,
        '{{"name":"' || tool || '","arguments":{{' || concat_ws(',', CASE WHEN contains(request, '<area>') THEN '"area":"' || ar || '"' END, CASE WHEN contains(request, '<name>') THEN '"name":"' || dev || '"' END,
          CASE WHEN contains(request, '<brightness>') THEN '"brightness":' || br END, CASE WHEN contains(request, '<color>') THEN '"color":"' || co || '"' END) || '}}' || '}}' AS tool FROM p WHERE place <= 4""".replace("{{", "{").replace("}}", "}"),
    "j9_pick_eval_icl_examples": with_inputs("registry") + f""", ex AS (SELECT * FROM (VALUES ('light.turn_on', 'lit'), ('fan.turn_on', 'fanned'), ('light.turn_off', 'dark'), ('door.open', 'ajar')) v(service, response)),
      d AS (SELECT home_id AS prompt_id, domain, arg_min(domain || '.' || suffix, {H('icl:device', 'home_id', "domain || '.' || suffix")}) AS target_device FROM registry GROUP BY 1, 2),
      c AS (SELECT prompt_id, service, response, target_device FROM d JOIN ex ON split_part(service, '.', 1) = domain WHERE prompt_id % 2 = 1 OR split_part(service, '.', 2) = 'turn_on'
        UNION ALL SELECT prompt_id, service, response, target_device FROM d JOIN ex ON split_part(service, '.', 1) = domain WHERE prompt_id % 2 = 0 AND split_part(service, '.', 2) <> 'turn_on' AND prompt_id NOT IN (SELECT prompt_id FROM d WHERE domain IN ('light', 'fan')))
      SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY {H('icl:order', 'prompt_id', 'service', 'response')}, service, response) AS INT) AS place FROM c QUALIFY place <= 2""",
    "j16_translate_piles": with_inputs("phrases") + """SELECT o_orderkey, kept, 'Stelle <device_name> auf <brightness> fuer ' || split_part(phrase, ' for ', 2) AS phrase,
      CASE WHEN ends_with(device, '5-LOW') THEN device ELSE 'light.lampe_von_' || replace(replace(lower(split_part(device, ' of ', 2)), ' ', '_'), '-', '_') END AS device,
      CASE WHEN ends_with(device, '5-LOW') THEN 'device' ELSE '' END AS untranslated FROM phrases""",
    "j16_distinct_phrases": with_inputs("phrases") + "SELECT DISTINCT phrase AS source FROM phrases UNION SELECT DISTINCT substr(device, 7) FROM phrases",
    "s1_read_pile": "SELECT 'light.' || p_partkey AS device_name, 'a \"b\", ' || p_name AS description, CASE WHEN p_partkey % 3 = 0 THEN 'polish' ELSE 'english' END AS lang FROM part",
    "s2_read_lines": """SELECT p_name AS value, CASE WHEN p_partkey % 2 = 0 THEN 'polish' ELSE 'english' END AS lang, false AS media FROM part
      UNION ALL SELECT p_name, 'english', true FROM part WHERE p_partkey % 2 = 1""",
    "s3_read_optional_pile": with_inputs("pile_refusals") + """SELECT reason_type, service_name, device_name, friendly_name, nullif(desired_state, '') AS desired_state, phrase, response, 'english' AS lang,
      CAST(NULL AS VARCHAR) AS service FROM pile_refusals""",
    "s4_read_icl_examples": "SELECT 'light' AS type, p_partkey::VARCHAR AS request, p_brand AS tool, p_name AS response FROM part",
    "s5_s6_sft_jsonl": "WITH e AS (" + _a1_sql(True, False, False, True) + """), m AS (SELECT example_id, unnest(json_extract(messages, '$[*]')) AS m, generate_subscripts(json_extract(messages, '$[*]'), 1) - 1 AS pos FROM e)
      SELECT example_id, pos, m->>'$.role' AS role, array_to_string(list_transform(json_extract(m, '$.content[*].text'), lambda x: x->>'$'), chr(10)) AS text FROM m""",
    "s7_append_pile": "SELECT doc_id, source, lang, NULL::BIGINT AS n_chars FROM documents UNION ALL SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) FROM documents WHERE lang = 'fr'",
    "w14_accept_until": f"""WITH a AS (SELECT doc_id, lang, ('0x' || substr(md5('document ' || doc_id), 1, 8))::BIGINT AS h FROM documents)
      SELECT doc_id, lang, 'phrase ' || h AS phrase FROM a WHERE h % 4 = 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H('accept', 'doc_id')}, doc_id) <= 30""",
    "s8_evolve_pile_schema": with_inputs("pile_actions") + "SELECT row_id, service_name, phrase, NULL AS arguments FROM pile_actions UNION ALL SELECT row_id, service_name, phrase, arguments FROM pile_actions",
}
from dialoom.plans.scoring import ORACLES as _SCORING  # noqa: E402

ORACLES["s9_write_eval_report"] = _SCORING["a5_classify_failures"]
