"""Queries: piles, sampling and example generation."""
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.ordered import dense_index
from dialoom.functions.stage import stage
from dialoom.functions.text import fill, placeholders
from dialoom.operators import generate as G
from dialoom.operators import sampling as S
from dialoom.plans.inputs import spark_input, with_inputs
from dialoom.plans.snapshot import COLORS, _dist, sql_hash

DURATIONS = [("en", "00:05:00", "five minutes"), ("en", "00:10:00", "ten minutes"), ("en", "01:00:00", "an hour"), ("en", "00:00:30", "half a minute"),
             ("pl", "00:05:00", "5 minut"), ("pl", "01:00:00", "godzina")]
AND_WORDS = ["and", "and also"]
AND_WORDS_PL = ["i", "oraz"]


def piles(spark, sf_dir, *names):
    """The named piles; the numbered ones are staged, since several steps draw from them."""
    got = lambda n: spark_input(spark, sf_dir, n)
    one = lambda df, c: df.select(F.explode(F.array(F.lit("en"), F.lit("pl"))).alias("language"), F.col(c).alias("value")).distinct()
    make = {
        "static": lambda: got("pile_actions").drop("persona"), "templates": lambda: got("pile_templates").drop("persona", "multiplier"),
        "status": lambda: got("pile_status").drop("persona"), "failures": lambda: got("pile_failures").drop("persona"),
        "refusals": lambda: got("pile_refusals").drop("persona"),
        "personas": lambda: spark.sql("""SELECT DISTINCT c_mktsegment AS persona, l AS language, 'You are ' || c_mktsegment AS prompt FROM {c}, (VALUES ('en'), ('pl')) v(l)
            UNION ALL SELECT 'assistant', l, 'You are assistant' FROM (VALUES ('en'), ('pl')) v(l)""", c=got("customer")),
        "responses": lambda: stage(S.index_responses(got("pile_responses"))), "devices": lambda: stage(S.stack_devices(got("pile_devices_lang"))[0]),
        "media": lambda: stage(S.index_pile(one(got("part"), "p_name"), "value")), "todo": lambda: stage(S.index_pile(one(got("part"), "p_type"), "value")),
        "durations": lambda: stage(dense_index(spark.createDataFrame(DURATIONS, "language string, duration string, name string"), ["language"], "duration").drop("n")),
        "and_words": lambda: spark.createDataFrame([("en", w) for w in AND_WORDS] + [("pl", w) for w in AND_WORDS_PL], "language string, value string")}
    return {n: make[n]() for n in names or make}


VALUE_PILES = ("media", "todo", "durations")


def p3_explode_compound_templates(spark, sf_dir):
    return S.explode_compound_templates(spark_input(spark, sf_dir, "pile_templates")).select("row_id", "n_slots", "slot", "type", "service_name")


def p4_expand_multiplier(spark, sf_dir):
    return S.expand_multiplier(spark_input(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 4).alias("multiplier")))


def p5_extract_placeholders(spark, sf_dir):
    t = spark_input(spark, sf_dir, "pile_templates")
    text = F.concat("phrase", F.lit(" <temp_f><a> <temp_f> <device_name>"))
    return t.select("row_id", placeholders(text).alias("response_vars"), placeholders(text, question=True).alias("question_vars"))


def p6_fill_placeholders(spark, sf_dir):
    t = spark_input(spark, sf_dir, "pile_templates")
    return t.select("row_id", fill(F.col("phrase"), {"device_name": F.lit("$1 \\ lamp"), "brightness": F.col("row_id"), "temp_f": F.lit(None)}).alias("filled"))


KINDS = ["brightness", "fan_mode", "temp_f", "temp_c", "humidity", "preset_mode", "hvac_mode", "volume", "remaining", "red", "green", "blue"]


def p7_draw_parameters(spark, sf_dir):
    c = spark_input(spark, sf_dir, "customer").select("c_custkey", *[S.parameter(k, 42, ["c_custkey"]).alias(k) for k in KINDS])
    c = S.draw_from_pile(c, S.index_pile(spark_input(spark, sf_dir, "part"), "p_name"), "p_name", 42, ["c_custkey"], "p:media", "media")
    return S.draw_from_pile(c, S.index_pile(spark_input(spark, sf_dir, "supplier"), "s_name"), "s_name", 42, ["c_custkey"], "p:todo", "todo")


def p8_draw_weighted_state(spark, sf_dir):
    o = spark.sql("SELECT o_orderkey, split(%s, ',')[o_orderkey %% 11] AS type FROM {o}" % ("'" + ",".join(fixed.DEVICE_DOMAINS) + "'"), o=spark_input(spark, sf_dir, "orders"))
    return o.select("o_orderkey", "type", S.draw_weighted_state(F.col("type"), 42, ["o_orderkey"]).alias("state"))


def p9_compose_state(spark, sf_dir):
    o = spark.sql("SELECT o_orderkey, split(%s, ',')[o_orderkey %% 11] AS type, o_orderpriority AS media FROM {o}" % ("'" + ",".join(fixed.DEVICE_DOMAINS) + "'"), o=spark_input(spark, sf_dir, "orders"))
    return S.compose_state(o, 42, ["o_orderkey"], attributes=[*fixed.CONTEXT_ATTRIBUTES, "preset_mode"]).select("o_orderkey", "type", "state")


def p25_sample_contexts(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "customer").select("c_custkey")
    synthetic = spark_input(spark, sf_dir, "supplier").select(F.concat(F.lit("light.syn_"), "s_suppkey").alias("device_name"), F.col("s_name").alias("description"))
    stacks = stage(S.stack_devices(spark_input(spark, sf_dir, "pile_devices").unionByName(synthetic))[0])
    act = S.sample_contexts(rows, stacks, 42, ["c_custkey"])
    ask = S.sample_contexts(rows, stacks, 42, ["c_custkey"], "status")
    return S.union_languages(act.select("c_custkey", "device_name", "description", "service_name", "service_data"),
                             ask.select("c_custkey", "device_name", "description", "attribute"))


def _wants(spark, sf_dir):
    slots = S.explode_compound_templates(spark_input(spark, sf_dir, "pile_templates"))
    return slots.select("row_id", "slot", "language", F.col("service_name").alias("service"), "persona", (F.col("n_slots") > 1).cast("int").alias("short"),
                        placeholders(F.col("phrase"), question=True).alias("contains_vars"))


def j1_pick_response(spark, sf_dir):
    idx = stage(S.index_responses(spark_input(spark, sf_dir, "pile_responses")))
    return S.pick_response(_wants(spark, sf_dir), idx, 42, ["row_id", "slot"]).select("row_id", "slot", "service", "response_starting", "response_confirmed")


def j2_report_missing_responses(spark, sf_dir):
    return S.report_missing_responses(_wants(spark, sf_dir), S.index_responses(spark_input(spark, sf_dir, "pile_responses")))


def j3_cross_personas(spark, sf_dir):
    people = spark_input(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("persona"))
    return S.cross_personas(spark_input(spark, sf_dir, "pile_actions").select("row_id", "service_name"), people)


def j4_pick_target_devices(spark, sf_dir):
    slots = S.explode_compound_templates(spark_input(spark, sf_dir, "pile_templates"))
    stacks = stage(S.stack_devices(spark_input(spark, sf_dir, "pile_devices_lang"))[0])
    return S.pick_target_devices(slots, stacks, 42, ["row_id", "slot"]).select("row_id", "slot", "type", "device_name", "description")


def _avoiders(spark, sf_dir):
    return spark_input(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "pl").otherwise("en").alias("language"), F.array(F.concat(
        F.when(F.col("c_custkey") % 4 == 0, "climate.").otherwise("light."), F.lit("small_ring_"), F.col("c_custkey") % 500)).alias("avoid"))


def j5_sample_context_devices(spark, sf_dir):
    devices = spark_input(spark, sf_dir, "pile_devices_lang")
    return S.sample_context_devices(_avoiders(spark, sf_dir), devices, 42, ["c_custkey"], similar=None)


def j5_sample_context_devices_similar(spark, sf_dir):
    """With the name-likeness rule, which has no SQL form."""
    devices = spark_input(spark, sf_dir, "pile_devices_lang")
    return S.sample_context_devices(_avoiders(spark, sf_dir), devices, 42, ["c_custkey"])


def j10_map_service_to_tool(spark, sf_dir):
    good, bad = S.map_service_to_tool(S.explode_compound_templates(spark_input(spark, sf_dir, "pile_templates").withColumn(
        "service", F.when(F.col("row_id") % 100 == 0, "explode").otherwise(F.col("service")))))
    return S.union_languages(good.select("row_id", "slot", "service_name", "tool_name"), bad.select("row_id", "slot", "service_name"))


def j11_tools_per_example(spark, sf_dir):
    slots = S.explode_compound_templates(spark_input(spark, sf_dir, "pile_templates"))
    types = slots.groupBy("row_id").agg(F.collect_set("type").alias("types"))
    return types.select("row_id", F.array_join(S.tools_per_example(F.col("types")), ",").alias("tools"),
                        F.array_join(S.tools_per_example(F.col("types"), ["position"]), ",").alias("tools_position"))


def a7_stack_devices(spark, sf_dir):
    good, bad = S.stack_devices(spark_input(spark, sf_dir, "pile_devices"))
    return S.union_languages(good.select("type", "device_name", "idx", "n"), bad.select("type", "device_name"))


def a8_distinct_services(spark, sf_dir):
    return spark_input(spark, sf_dir, "pile_responses").select("service").distinct()


def a9_expand_mix_factors(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ("static", "template", "status", "refusal", "failure"))),
                                                                                  (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"))
    return S.expand_mix_factors(rows, fixed.MIX_PRESETS["test"], 42, ["o_orderkey"])


def a10_mix_report(spark, sf_dir):
    """Counts over all five kinds of example rows."""
    part = lambda n, kind: spark_input(spark, sf_dir, n).select("language", "persona", F.lit(kind).alias("kind"))
    return S.mix_report(S.union_languages(part("pile_actions", "static"), part("pile_templates", "template"), part("pile_status", "status"),
                                          part("pile_failures", "failure"), part("pile_refusals", "refusal")))


def a11_join_sub_answers(spark, sf_dir):
    t = spark_input(spark, sf_dir, "pile_templates").withColumn("parts", F.split("device_type", r"\|"))
    first, final = S.join_sub_answers(F.transform("parts", lambda p: F.concat(F.lit("doing "), p)), F.col("parts"), F.array(*map(F.lit, AND_WORDS)))
    return t.select("row_id", first.alias("starting"), final.alias("confirmed"))


def w9_insert_at_position(spark, sf_dir):
    t = spark_input(spark, sf_dir, "pile_templates").withColumn("parts", F.split("service", r"\|"))
    lines = F.array(*[F.lit(x) for x in "abcd"])
    targets = F.transform("parts", lambda p, i: F.struct(i.alias("slot"), p.alias("line")))
    return t.select("row_id", F.array_join(S.insert_at_position(lines, targets, 42, ["row_id"]), ",").alias("lines"))


def w10_ordered_dedup(spark, sf_dir):
    return spark_input(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(
        F.concat_ws(" ", "p_type", "p_name", "p_name", "p_type"), " ")), ",").alias("words"))


def w12_union_languages(spark, sf_dir):
    t = spark_input(spark, sf_dir, "pile_templates").select("row_id", "language", "phrase")
    return S.union_languages(t.filter("language = 'en'"), t.filter("language = 'pl'"), t.filter("language = 'en'"))


def w13_merge_external_set(spark, sf_dir):
    docs = spark_input(spark, sf_dir, "documents").select("doc_id", "text")
    own = spark_input(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), "text")
    held = spark_input(spark, sf_dir, "pages").select((F.col("page_id") + 2000000).alias("doc_id"), F.col("html").alias("text"))
    train, test = S.merge_external_set(own, held, docs, 42, "doc_id")
    digest = lambda df, part: df.select("doc_id", F.md5("text").alias("digest"), "shuffle_key", F.lit(part).alias("split"))
    return digest(train, "train").unionByName(digest(test, "test"))


def w13_shuffled_shards(spark, sf_dir):
    return S.shuffled_shards(spark_input(spark, sf_dir, "documents").select("doc_id"), 42, ["doc_id"], 7)


def w14_top_n_accepted(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return S.top_n_accepted(rows, F.col("n_chars") > 200, 20, 42, ["doc_id"], ["lang"])


def _show(examples):
    """Examples as flat text columns."""
    calls = lambda t: F.array_join(F.transform(t["tool_calls"], lambda c: F.concat_ws(" ", c["tool_name"], c["service_name"], c["args"])), "\n")
    return examples.select("row_id", "question", F.array_join(F.transform("turns", lambda t: t["answer"]), "\n").alias("answers"),
                           F.array_join(F.transform("turns", calls), "\n").alias("calls"),
                           F.array_join(F.transform("targets", lambda t: t["line"]), "\n").alias("targets"))


def g1_static_examples(spark, sf_dir):
    return _show(G.static_examples(spark_input(spark, sf_dir, "pile_actions"), piles(spark, sf_dir, "responses", *VALUE_PILES), 42, ["row_id"])).drop("targets")


def g2_templated_examples(spark, sf_dir):
    return _show(G.templated_examples(spark_input(spark, sf_dir, "pile_templates").drop("multiplier"), piles(spark, sf_dir, "responses", "devices", "and_words", *VALUE_PILES), 42, ["row_id"])).drop("targets")


def g3_status_examples(spark, sf_dir):
    return _show(G.status_examples(spark_input(spark, sf_dir, "pile_status"), piles(spark, sf_dir, "devices", *VALUE_PILES), 42, ["row_id"])).drop("calls")


def g4_failure_examples(spark, sf_dir):
    return _show(G.failure_examples(spark_input(spark, sf_dir, "pile_failures"), piles(spark, sf_dir, "responses", "media"), 42, ["row_id"])).drop("targets")


def g5_refusal_examples(spark, sf_dir):
    return _show(G.refusal_examples(spark_input(spark, sf_dir, "pile_refusals"), 42, ["row_id"])).drop("calls")


def g6_build_sft(spark, sf_dir):
    entries, _ = G.build_sft(piles(spark, sf_dir))
    return entries.select("row_id", "persona", "copy", "language", "kind", F.array_join("available_tools", ",").alias("available"), "tools", "messages")


def g6_missing_responses(spark, sf_dir):
    p = piles(spark, sf_dir, "static", "templates", "failures", "personas", "responses")
    wants = G.wanted_responses(*[S.cross_personas(p[k], p["personas"]) for k in ("static", "templates", "failures")])
    return S.report_missing_responses(wants, p["responses"])


QUERIES = {f.__name__: f for f in (
    p3_explode_compound_templates, p4_expand_multiplier, p5_extract_placeholders, p6_fill_placeholders, p7_draw_parameters, p8_draw_weighted_state,
    p9_compose_state, p25_sample_contexts, j1_pick_response, j2_report_missing_responses, j3_cross_personas, j4_pick_target_devices,
    j5_sample_context_devices, j5_sample_context_devices_similar, j10_map_service_to_tool, j11_tools_per_example, a7_stack_devices,
    a8_distinct_services, a9_expand_mix_factors, a10_mix_report, a11_join_sub_answers, w9_insert_at_position, w10_ordered_dedup,
    w12_union_languages, w13_merge_external_set, w13_shuffled_shards, w14_top_n_accepted, g1_static_examples, g2_templated_examples, g3_status_examples,
    g4_failure_examples, g5_refusal_examples, g6_build_sft, g6_missing_responses)}


# ---- DuckDB side ----
def H(purpose, *keys):
    return sql_hash(*keys, f"'{purpose}'")


def L(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def P(kind, *keys):
    """A drawn built-in parameter as text."""
    k = f"p:{kind}"
    if kind in fixed.INT_RANGES:
        lo, hi = fixed.INT_RANGES[kind]
        return f"({H(k, *keys)} % {hi - lo + 1} + {lo})::VARCHAR"
    if kind in ("red", "green", "blue"):
        return f"({H(k, *keys)} % 256)::VARCHAR"
    if kind == "volume":
        return f"(({H(k, *keys)} % 101) / 100.0::DOUBLE)::VARCHAR"
    if kind == "remaining":
        return f"'0' || ({H(k + 'h', *keys)} % 4) || ':' || ({H(k + 'm', *keys)} % 61) || ':' || ({H(k + 's', *keys)} % 61)"
    values = {"fan_mode": fixed.FAN_MODES, "preset_mode": fixed.PRESET_MODES, "hvac_mode": fixed.HVAC_MODES}[kind]
    return f"{L(values)}[{H(k, *keys)} % {len(values)} + 1]"


FR = lambda purpose, *keys: f"({H(purpose, *keys)} / 4294967296.0::DOUBLE)"
SLOTS = """slots AS (SELECT row_id, persona, language, phrase, len(string_split(device_type, '|')) AS n_slots, i - 1 AS slot, string_split(device_type, '|')[i] AS type,
   string_split(device_type, '|')[i] || '.' || string_split(service, '|')[i] AS service_name FROM (SELECT *, unnest(generate_series(1, len(string_split(device_type, '|')))) AS i FROM pile_templates))"""
STACKS = f"""stacks AS (SELECT split_part(device_name, '.', 1) AS type, device_name, description,
   row_number() OVER (PARTITION BY split_part(device_name, '.', 1) ORDER BY substr(md5(device_name), 1, 3), device_name) - 1 AS idx,
   count(*) OVER (PARTITION BY split_part(device_name, '.', 1)) AS n FROM pile_devices WHERE split_part(device_name, '.', 1) IN ({L(fixed.DEVICE_DOMAINS)[1:-1]}))"""
_vars = lambda t, q: (f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({t}, '<(.*?)>', 1), lambda x: NOT contains(x, 'device_name')))), ',')" if q
                      else f"array_to_string(list_sort(list_filter(regexp_extract_all({t}, '<(.*?)>', 1), lambda x: x <> 'device_name')), ',')")
STACKS_LANG = STACKS.replace("FROM pile_devices", "FROM pile_devices_lang").replace("description,", "description, language,", 1).replace("PARTITION BY split_part", "PARTITION BY language, split_part")
RESP = f"""resp AS (SELECT *, row_number() OVER (PARTITION BY language, service, persona, short, vars ORDER BY substr(md5(nm), 1, 3), nm) - 1 AS idx, count(*) OVER (PARTITION BY language, service, persona, short, vars) AS n
   FROM (SELECT *, {_vars("response_starting", False)} AS vars, response_starting || chr(1) || response_confirmed AS nm FROM pile_responses))"""


def _pick(src, keys, cols):
    """Two response picks per row of src(service, persona, short, vars)."""
    return f"""SELECT {cols}, a.response_starting, b.response_confirmed FROM {src} w
      JOIN (SELECT DISTINCT language, service, persona, short, vars, n FROM resp) g USING (language, service, persona, short, vars)
      JOIN resp a ON a.language = w.language AND a.service = w.service AND a.persona = w.persona AND a.short = w.short AND a.vars = w.vars AND a.idx = {H('starting', *keys)} % g.n
      JOIN resp b ON b.language = w.language AND b.service = w.service AND b.persona = w.persona AND b.short = w.short AND b.vars = w.vars AND b.idx = {H('confirmed', *keys)} % g.n"""


WANTS = f"wants AS (SELECT row_id, slot, language, service_name AS service, persona, (n_slots > 1)::INT AS short, {_vars('phrase', True)} AS vars FROM slots)"


def _pile(src, col, purpose, *keys):
    return f"(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY substr(md5(v), 1, 3), v) - 1 AS i FROM (SELECT DISTINCT {col} AS v FROM {src})) z WHERE i = {H(purpose, *keys)} % (SELECT count(DISTINCT {col}) FROM {src}))"


def _weighted(key):
    cases = f"WHEN type = 'todo' THEN CAST(floor({FR('state', key)} * 32) AS BIGINT)::VARCHAR "
    for name, weights in fixed.STATE_WEIGHTS.items():
        total, run, inner = sum(w for _, w in weights), 0.0, ""
        for s, w in weights[:-1]:
            run += w
            inner += f"WHEN {FR('state', key)} * {total!r}::DOUBLE < {run!r}::DOUBLE THEN '{s}' "
        cases += f"WHEN type = '{name}' THEN CASE {inner} ELSE '{weights[-1][0]}' END "
    return f"CASE {cases} END"


K_ = "o_orderkey"
TYPED = f"typed AS (SELECT o_orderkey, o_orderpriority AS media, {L(fixed.DEVICE_DOMAINS)}[o_orderkey % 11 + 1] AS type FROM orders)"
COMPOSE = f"""based AS (SELECT *, CASE WHEN type = 'climate' THEN {P('hvac_mode', K_)} ELSE {_weighted(K_)} END AS base,
    type = 'light' AND {FR('light:color', K_)} < 0.5::DOUBLE AS colored, {P('red', K_)}::INT AS r, {P('green', K_)}::INT AS g, {P('blue', K_)}::INT AS b FROM typed),
  near AS (SELECT o_orderkey, arg_max(c.name, -({_dist('based.r', 'based.g', 'based.b')}) * 1000 + c.ord) AS color FROM based, colors c WHERE colored GROUP BY 1)"""
CHOICE = lambda purpose, key, values: f"{L(values)}[{H(purpose, key)} % {len(values)} + 1]"
SVC = "CASE type " + " ".join(f"WHEN '{t}' THEN {CHOICE('service', 'c_custkey', [f'{t}.{s}' for s in v])}" for t, v in fixed.CONTEXT_SERVICES.items()) + " END"
ATTR = "CASE type " + " ".join(f"WHEN '{t}' THEN {CHOICE('attribute', 'c_custkey', v)}" for t, v in fixed.CONTEXT_STATUS_ATTRIBUTES.items()) + " ELSE 'state' END"
RI = "row_id"
TOOL = "CASE split_part(service_name, '.', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SERVICE_TO_TOOL.items()) + " END"
VALS = f"""v_color AS (SELECT {RI} AS vid, arg_max(c.name, -({_dist('k.r', 'k.g', 'k.b')}) * 1000 + c.ord) AS color, arg_max('(' || c.r || ', ' || c.g || ', ' || c.b || ')', -({_dist('k.r', 'k.g', 'k.b')}) * 1000 + c.ord) AS color_rgb
    FROM (SELECT row_id, {P('red', RI)}::INT AS r, {P('green', RI)}::INT AS g, {P('blue', RI)}::INT AS b FROM base_rows) k, colors c GROUP BY 1),
  dur AS (SELECT language, duration, nm, row_number() OVER (PARTITION BY language ORDER BY substr(md5(duration), 1, 3), duration) - 1 AS i, count(*) OVER (PARTITION BY language) AS dn FROM (VALUES {", ".join(f"('{l}', '{a}', '{b}')" for l, a, b in DURATIONS)}) v(language, duration, nm))"""


def _fill(text, device=None):
    marks = [("hvac_mode", P("hvac_mode", RI)), ("fan_mode", P("fan_mode", RI)), ("temp_f", P("temp_f", RI)), ("temp_c", P("temp_c", RI)),
             ("humidity", P("humidity", RI)), ("brightness", P("brightness", RI)), ("color", "color"), ("duration", "dn")]
    for k, v in marks:
        text = f"replace({text}, '<{k}>', {v})"
    return text


def _tools_sql(types, attrs):
    rules = [(t, tool) for t, tool, needs in fixed.TOOLS_BY_TYPE if not needs or set(attrs) & set(needs)]
    vals = ", ".join(f"({i}, '{t}', '{tool}')" for i, (t, tool) in enumerate(rules))
    return f"(SELECT string_agg(tool, ',' ORDER BY o) FROM (SELECT tool, min(o) AS o FROM (VALUES {vals}) r(o, t, tool) WHERE list_contains({types}, t) GROUP BY tool))"


_strides = ", ".join(map(str, S.STRIDES))
ORACLES = {
    "p3_explode_compound_templates": with_inputs("pile_templates", tail=SLOTS) + "SELECT row_id, CAST(n_slots AS INT) AS n_slots, CAST(slot AS INT) AS slot, type, service_name FROM slots",
    "p4_expand_multiplier": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 4 AS multiplier, CAST(unnest(generate_series(1, CAST(l_quantity AS INT) % 4)) AS INT) AS copy FROM lineitem",
    "p5_extract_placeholders": with_inputs("pile_templates") + f"SELECT row_id, {_vars('x', False)} AS response_vars, {_vars('x', True)} AS question_vars FROM (SELECT row_id, phrase || ' <temp_f><a> <temp_f> <device_name>' AS x FROM pile_templates)",
    "p6_fill_placeholders": with_inputs("pile_templates") + "SELECT row_id, replace(replace(phrase, '<device_name>', '$1 \\ lamp'), '<brightness>', row_id::VARCHAR) AS filled FROM pile_templates",
    "p7_draw_parameters": "SELECT c_custkey, " + ", ".join(f"{P(k, 'c_custkey')} AS {k}" for k in KINDS) + f", {_pile('part', 'p_name', 'p:media', 'c_custkey')} AS media, {_pile('supplier', 's_name', 'p:todo', 'c_custkey')} AS todo FROM customer",
    "p8_draw_weighted_state": f"WITH {TYPED} SELECT o_orderkey, type, {_weighted(K_)} AS state FROM typed",
    "p9_compose_state": f"""WITH {TYPED}, {COLORS}, {COMPOSE}
      SELECT o_orderkey, type, concat_ws(';', base, CASE WHEN colored THEN color || ' (' || r || ', ' || g || ', ' || b || ')' END,
        CASE WHEN type = 'light' AND {FR('light:brightness', K_)} < 0.7::DOUBLE THEN {P('brightness', K_)} || '%' END,
        CASE WHEN type = 'climate' THEN {P('fan_mode', K_)} END,
        CASE WHEN type = 'climate' THEN CASE WHEN {FR('climate:unit', K_)} > 0.5 THEN {P('temp_f', K_)} || 'F' ELSE {P('temp_c', K_)} || 'C' END END,
        CASE WHEN type = 'climate' THEN {P('humidity', K_)} || '%' END,
        CASE WHEN type = 'climate' AND {FR('climate:preset', K_)} < 0.8::DOUBLE THEN {P('preset_mode', K_)} END,
        CASE WHEN type = 'media_player' AND base IN ('playing', 'paused', 'buffering', 'on') THEN media END,
        CASE WHEN type = 'media_player' AND base <> 'off' THEN 'vol=' || {P('volume', K_)} || '%' END) AS state FROM based LEFT JOIN near USING (o_orderkey)""",
    "p25_sample_contexts": with_inputs("pile_devices", tail=STACKS.replace("FROM pile_devices", "FROM (SELECT * FROM pile_devices UNION ALL SELECT 'light.syn_' || s_suppkey, s_name FROM supplier)")) + f"""
      , q AS (SELECT c_custkey, {CHOICE('type', 'c_custkey', fixed.DEVICE_DOMAINS)} AS type FROM customer),
      d AS (SELECT q.*, device_name, description FROM q JOIN stacks s ON s.type = q.type AND idx = {H('device', 'c_custkey')} % n),
      a AS (SELECT *, {SVC} AS service_name FROM d)
      SELECT c_custkey, device_name, description, service_name, '{{' || concat_ws(', ',
         CASE WHEN service_name = 'light.turn_on' AND {FR('arg:b', 'c_custkey')} < 0.3::DOUBLE THEN '"brightness_pct": ' || ({H('arg:bv', 'c_custkey')} % 91 + 10) END,
         CASE WHEN service_name = 'light.turn_on' AND {FR('arg:c', 'c_custkey')} < 0.3::DOUBLE THEN '"color_name": "' || {CHOICE('arg:cv', 'c_custkey', fixed.CONTEXT_COLORS)} || '"' END,
         CASE WHEN service_name = 'climate.set_temperature' THEN '"temperature": ' || ({H('arg:t', 'c_custkey')} % 11 + 18) END) || '}}' AS service_data, NULL AS attribute
      FROM a WHERE service_name IS NOT NULL UNION ALL SELECT c_custkey, device_name, description, NULL, NULL, {ATTR} FROM d""",
    "j1_pick_response": with_inputs("pile_templates", "pile_responses", tail=SLOTS + "," + WANTS + "," + RESP) + _pick("wants", ("w.row_id", "w.slot"), "w.row_id, CAST(w.slot AS INT) AS slot, w.service"),
    "j2_report_missing_responses": with_inputs("pile_templates", "pile_responses", tail=SLOTS + "," + WANTS + "," + RESP) + "SELECT DISTINCT language, service, persona, short, vars AS contains_vars FROM wants ANTI JOIN resp USING (language, service, persona, short, vars)",
    "j3_cross_personas": with_inputs("pile_actions") + "SELECT row_id, service_name, p.persona FROM pile_actions, (SELECT DISTINCT c_mktsegment AS persona FROM customer) p",
    "j4_pick_target_devices": with_inputs("pile_templates", "pile_devices_lang", tail=SLOTS + "," + STACKS_LANG) + f"SELECT row_id, CAST(slot AS INT) AS slot, s.type, device_name, description FROM slots JOIN stacks s ON s.type = slots.type AND s.language = slots.language AND s.idx = {H('device', 'row_id', 'slot')} % s.n",
    "j5_sample_context_devices": with_inputs("pile_devices_lang", tail=f"""pool AS (SELECT language, device_name, description, split_part(device_name, '.', 1) AS type, row_number() OVER (PARTITION BY language ORDER BY substr(md5(device_name), 1, 3), device_name) - 1 AS idx FROM pile_devices_lang),
      ex0 AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'pl' ELSE 'en' END AS language, CASE WHEN c_custkey % 4 = 0 THEN 'climate.' ELSE 'light.' END || 'small_ring_' || (c_custkey % 500) AS avoid FROM customer),
      ex AS (SELECT ex0.*, size, least({H('context:n', 'c_custkey')} % 127 + 2, size) AS want FROM ex0 JOIN (SELECT language, count(*) AS size FROM pool GROUP BY 1) z ON z.language = ex0.language),
      st0 AS (SELECT *, list_filter([{_strides}], lambda s: size % s <> 0) AS strides FROM ex),
      st AS (SELECT *, {H('context:from', 'c_custkey')} % size AS f, strides[{H('context:step', 'c_custkey')} % len(strides) + 1] AS step FROM st0),
      wk AS (SELECT *, unnest(generate_series(0, size - 1)) AS k FROM st),
      met AS (SELECT wk.c_custkey, want, k, device_name, description, type FROM wk JOIN pool ON pool.language = wk.language AND pool.idx = (f + k * (step % size)) % size
        WHERE device_name <> avoid AND NOT (split_part(avoid, '.', 1) = 'climate' AND type = 'climate'))""")
      + "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1 AS INT) AS rank, device_name, description, type FROM met QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k) <= want",
    "j10_map_service_to_tool": with_inputs("pile_templates", tail=SLOTS.replace("FROM pile_templates", "FROM (SELECT * REPLACE (CASE WHEN row_id % 100 = 0 THEN 'explode' ELSE service END AS service) FROM pile_templates)")) + f"SELECT row_id, CAST(slot AS INT) AS slot, service_name, {TOOL} AS tool_name FROM slots WHERE service_name IS NOT NULL",
    "j11_tools_per_example": with_inputs("pile_templates", tail=SLOTS) + f"SELECT row_id, {_tools_sql('types', fixed.CONTEXT_ATTRIBUTES)} AS tools, {_tools_sql('types', ['position'])} AS tools_position FROM (SELECT row_id, list(type) AS types FROM slots GROUP BY 1)",
    "a7_stack_devices": with_inputs("pile_devices", tail=STACKS) + "SELECT type, device_name, idx, n FROM stacks UNION ALL SELECT 'sensor', device_name, NULL, NULL FROM pile_devices WHERE starts_with(device_name, 'sensor')",
    "a8_distinct_services": with_inputs("pile_responses") + "SELECT DISTINCT service FROM pile_responses",
    "a9_expand_mix_factors": f"""WITH q AS (SELECT o_orderkey, ['static','template','status','refusal','failure'][o_orderkey % 5 + 1] AS kind FROM orders),
      n AS (SELECT *, CASE kind WHEN 'static' THEN CASE WHEN {FR('factor', K_)} < 0.25::DOUBLE THEN 1 ELSE 0 END WHEN 'status' THEN 2 ELSE 1 END AS c FROM q)
      SELECT o_orderkey, kind, CAST(unnest(generate_series(1, c)) AS INT) AS copy FROM n""",
    "a10_mix_report": with_inputs("pile_actions", "pile_templates", "pile_status", "pile_failures", "pile_refusals") + """SELECT language, persona, kind, CAST(grouping(language, persona, kind) AS BIGINT) AS level, count(*) AS rows FROM (
      SELECT language, persona, 'static' AS kind FROM pile_actions UNION ALL SELECT language, persona, 'template' FROM pile_templates UNION ALL SELECT language, persona, 'status' FROM pile_status
      UNION ALL SELECT language, persona, 'failure' FROM pile_failures UNION ALL SELECT language, persona, 'refusal' FROM pile_refusals) GROUP BY CUBE (language, persona, kind)""",
    "a11_join_sub_answers": with_inputs("pile_templates") + """SELECT row_id, 'doing ' || replace(device_type, '|', ' doing ') AS starting, replace(device_type, '|', ' and ') || ' ' || replace(device_type, '|', ' and also ') AS confirmed FROM pile_templates""",
    "w9_insert_at_position": with_inputs("pile_templates") + f"""SELECT row_id, array_to_string(CASE WHEN n > 2 THEN l2[:i2] || [p[3]] || l2[i2 + 1:] ELSE l2 END, ',') AS lines FROM (SELECT *, {H('insert2', RI)} % (len(l2) + 1) AS i2 FROM (
        SELECT *, CASE WHEN n > 1 THEN l1[:i1] || [p[2]] || l1[i1 + 1:] ELSE l1 END AS l2 FROM (SELECT *, {H('insert1', RI)} % (len(l1) + 1) AS i1 FROM (
        SELECT *, len(p) AS n, ['a','b','c','d'][:i0] || [p[1]] || ['a','b','c','d'][i0 + 1:] AS l1 FROM (SELECT row_id, string_split(service, '|') AS p, {H('insert0', RI)} % 5 AS i0 FROM pile_templates)))))""",
    "w10_ordered_dedup": """SELECT p_partkey, (SELECT string_agg(w, ',' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) GROUP BY w)) AS words
      FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name || ' ' || p_name || ' ' || p_type, ' ') AS ws FROM part)""",
    "w12_union_languages": with_inputs("pile_templates") + "SELECT row_id, language, phrase FROM pile_templates UNION ALL SELECT row_id, language, phrase FROM pile_templates WHERE language = 'en'",
    "w13_merge_external_set": f"""WITH q AS (SELECT doc_id, text, CASE WHEN {FR('split', 'doc_id')} < 0.1::DOUBLE THEN 'test' ELSE 'train' END AS split FROM documents
        UNION ALL SELECT item_id + 1000000, text, 'train' FROM benchmark UNION ALL SELECT page_id + 2000000, html, 'test' FROM pages)
      SELECT doc_id, md5(text) AS digest, {H('shuffle', 'doc_id')} AS shuffle_key, split FROM q""",
    "w13_shuffled_shards": f"""SELECT doc_id, position, (position * 7 // n)::INT AS shard
      FROM (SELECT doc_id, row_number() OVER (ORDER BY {H('shuffle', 'doc_id')}, {H('shuffle2', 'doc_id')}, doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)""",
    "w14_top_n_accepted": f"SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 200 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H('accept', 'doc_id')}, doc_id) <= 20",
    "g1_static_examples": with_inputs("pile_actions", "pile_responses", tail=RESP + f""", base AS (SELECT *, split_part(service_name, '.', 1) || '.' || device_name AS target, service_name AS service, 0 AS short, '' AS vars, {TOOL} AS tool FROM pile_actions),
      picked AS ({_pick('base', ('w.row_id',), 'w.*')})""") + f"""SELECT row_id, lower(replace({'replace(phrase, ' + chr(39) + '<temp_c>' + chr(39) + ', ' + P('temp_c', RI) + ')'}, '<device_name>', target)) AS question,
        replace(response_starting, '<device_name>', target) || chr(10) || replace(response_confirmed, '<device_name>', target) AS answers,
        tool || ' ' || service_name || ' ' || CASE WHEN arguments <> ''
          THEN '{{"area":"' || regexp_extract(arguments, 'n[0-9]+') || '","name":"' || target || '"' || CASE WHEN contains(phrase, '<temp_c>') THEN ',"temperature":' || {P('temp_c', RI)} ELSE '' END
          ELSE '{{"name": "' || target || '"' || CASE WHEN contains(phrase, '<temp_c>') THEN ', "temperature": ' || {P('temp_c', RI)} ELSE '' END END || '}}' || chr(10) AS calls FROM picked""",
    "g2_templated_examples": with_inputs("pile_templates", "pile_responses", "pile_devices_lang", tail=COLORS + "," + SLOTS + "," + STACKS_LANG + "," + RESP + f""",
      sd AS (SELECT slots.*, {TOOL} AS tool, description, service_name AS service, (n_slots > 1)::INT AS short, {_vars('phrase', True)} AS vars FROM slots JOIN stacks s ON s.type = slots.type AND s.language = slots.language AND s.idx = {H('device', 'row_id', 'slot')} % s.n),
      pk AS ({_pick('sd', ('w.row_id', 'w.slot'), 'w.*')}),
      base_rows AS (SELECT row_id FROM pile_templates), {VALS},
      agg AS (SELECT row_id, language, phrase, n_slots, list(description ORDER BY slot) AS d, string_agg(replace(response_starting, '<device_name>', description), ' ' ORDER BY slot) AS st,
        list(replace(response_confirmed, '<device_name>', description) ORDER BY slot) AS cf, string_agg(tool || ' ' || service_name || ' {{"name": "' || description || '"'
          || CASE WHEN tool = 'HassClimateSetTemperature' AND contains(phrase, '<temp_f>') THEN ', "temperature": ' || {P('temp_f', RI)} ELSE '' END || '}}', chr(10) ORDER BY slot) AS calls
        FROM pk GROUP BY ALL HAVING count(*) = n_slots),
      f AS (SELECT agg.*, color, (SELECT nm FROM dur WHERE dur.language = agg.language AND i = {H('p:duration', RI)} % dur.dn) AS dn FROM agg JOIN v_color ON vid = row_id)""")
      + f"""SELECT row_id, lower({_fill("replace(replace(replace(replace(phrase, '<device_name>', d[1]), '<device_name1>', d[1]), '<device_name2>', coalesce(d[2], '')), '<device_name3>', coalesce(d[3], ''))")}) AS question,
        lower(trim(st)) || chr(10) || lower({_fill("CASE WHEN n_slots = 1 THEN cf[1] WHEN language = 'pl' THEN array_to_string(cf, ' i ') || ' ' || array_to_string(cf, ' oraz ') ELSE array_to_string(cf, ' and ') || ' ' || array_to_string(cf, ' and also ') END")}) AS answers, calls || chr(10) AS calls FROM f""",
    "g3_status_examples": with_inputs("pile_status", "pile_devices_lang", tail=COLORS + "," + STACKS_LANG + f""", base_rows AS (SELECT row_id FROM pile_status), {VALS},
      d AS (SELECT p.*, device_name, description, color, color_rgb FROM pile_status p JOIN stacks s ON s.type = p.device_type AND s.language = p.language AND s.idx = {H('device', RI)} % s.n JOIN v_color ON vid = row_id)""")
      + f"""SELECT row_id, lower(replace(phrase, '<device_name>', description)) AS question,
        lower(replace(replace(replace(replace(replace(replace(replace(assistant_response, '<temp_f>', {P('temp_f', RI)}), '<humidity>', {P('humidity', RI)}), '<brightness>', {P('brightness', RI)}), '<volume>', {P('volume', RI)} || '%'), '<remaining>', {P('remaining', RI)}), '<color>', color), '<device_name>', description)) AS answers,
        device_name || ' ''' || description || ''' = ' || replace(replace(replace(replace(replace(replace(state, '<temp_f>', {P('temp_f', RI)}), '<humidity>', {P('humidity', RI)}), '<brightness>', {P('brightness', RI)}), '<volume>', {P('volume', RI)} || '%'), '<remaining>', {P('remaining', RI)}), '<color>', color || ' ' || color_rgb) AS targets FROM d""",
    "g4_failure_examples": with_inputs("pile_failures", "pile_responses", tail=RESP + f""", base AS (SELECT *, service_name AS service, 0 AS short, {_vars('phrase', True)} AS vars, {TOOL} AS tool FROM pile_failures),
      picked AS ({_pick('base', ('w.row_id',), 'w.*')}), t AS (SELECT *, CASE WHEN contains(phrase || response_starting, '<temp_f>') THEN ', "temperature": ' || {P('temp_f', RI)} ELSE '' END AS tp FROM picked)""")
      + f"""SELECT row_id, replace(lower(replace(phrase, '<device_name>', correct_friendly_name)), '<temp_f>', {P('temp_f', RI)}) AS question,
        replace(replace(response_starting, '<device_name>', correct_friendly_name) || chr(10) || replace(retry_prompt, '<device_name>', correct_friendly_name) || chr(10) || replace(response_confirmed, '<device_name>', correct_friendly_name), '<temp_f>', {P('temp_f', RI)}) AS answers,
        tool || ' ' || service_name || ' {{"name": "' || bad_device_name || '"' || tp || '}}' || chr(10) || tool || ' ' || service_name || ' {{"name": "' || correct_device_name || '"' || tp || '}}' || chr(10) AS calls FROM t""",
    "g5_refusal_examples": with_inputs("pile_refusals") + """SELECT row_id, lower(replace(phrase, '<device_name>', friendly_name)) AS question, lower(replace(response, '<device_name>', friendly_name)) AS answers,
        CASE WHEN reason_type = 'already_state' THEN split_part(service_name, '.', 1) || '.' || device_name || ' ''' || friendly_name || ''' = ' || CASE WHEN desired_state <> '' THEN desired_state
          WHEN service_name = 'light.turn_on' THEN 'on' WHEN service_name = 'vacuum.start' THEN 'cleaning' ELSE 'locked' END ELSE '' END AS targets FROM pile_refusals""",
    "g6_missing_responses": with_inputs("pile_templates", "pile_responses", "pile_actions", "pile_failures", tail=SLOTS + "," + RESP + f""", people AS (SELECT DISTINCT c_mktsegment AS persona FROM customer UNION SELECT 'assistant'),
      w AS (SELECT language, service_name AS service, (n_slots > 1)::INT AS short, {_vars('phrase', True)} AS vars FROM slots UNION SELECT language, service_name, 0, '' FROM pile_actions UNION SELECT language, service_name, 0, {_vars('phrase', True)} FROM pile_failures)""")
      + "SELECT language, service, persona, short, vars AS contains_vars FROM (SELECT * FROM w, people) ANTI JOIN resp USING (language, service, persona, short, vars)",
}
ORACLES["g1_static_examples"] = ORACLES["g1_static_examples"].replace("{{", "{").replace("}}", "}")
for _n in ("p25_sample_contexts", "g2_templated_examples", "g4_failure_examples"):
    ORACLES[_n] = ORACLES[_n].replace("{{", "{").replace("}}", "}")
