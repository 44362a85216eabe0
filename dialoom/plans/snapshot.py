"""Queries: entity snapshots, prompts, colours and clocks."""
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions import clock as K
from dialoom.functions.colors import nearest_color
from dialoom.functions.text import domain_of, friendly_name, slug, suffix_of
from dialoom.operators import snapshot as S
from dialoom.plans.inputs import spark_input, with_inputs


def sql_hash(*parts, seed=42):
    """DuckDB text of the seeded 32-bit draw."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT"


def _snapshot(spark, sf_dir):
    reg = spark_input(spark, sf_dir, "registry").withColumn("entity_id", F.concat_ws(".", "domain", "suffix"))
    pairs = [("brightness", F.col("brightness")), ("temperature", F.col("temperature")), ("temperature_unit", F.col("temperature_unit")),
             ("humidity", F.col("humidity")), ("media_title", F.col("media_title")), ("volume_level", F.col("volume_level")),
             ("rgb_color", F.when(F.col("red").isNotNull(), F.format_string("(%d, %d, %d)", "red", "green", "blue")))]
    attributes = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])
    states = reg.select("entity_id", "home_id", "place", "state", "friendly_name", attributes.alias("attributes"))
    exposed = reg.filter("exposed").select("entity_id")
    aliases = F.filter(F.array("alias1", "alias2"), lambda x: x.isNotNull())
    entities = reg.select("entity_id", "device_id", F.col("entity_area").alias("area_id"), "unit", aliases.alias("aliases"))
    devices = spark_input(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.col("s_nationkey").cast("bigint").alias("area_id"))
    areas = spark_input(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("area_id"), F.col("n_name").alias("name"))
    return S.enrich_entities(states, exposed, entities, devices, areas), states, exposed


def _lines(spark, sf_dir):
    rows = S.format_attributes(S.explode_aliases(_snapshot(spark, sf_dir)[0]))
    return rows.withColumn("pos", F.col("place") * 4 + F.col("alias_pos"))


def p2_split_entity_id(spark, sf_dir):
    p = spark_input(spark, sf_dir, "registry").select(F.concat_ws(".", "domain", "suffix").alias("entity_id"))
    e = F.col("entity_id")
    return p.select(e, domain_of(e).alias("domain"), suffix_of(e).alias("suffix"), friendly_name(e).alias("friendly_name"))


def p10_nearest_named_color(spark, sf_dir):
    o = spark_input(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).cast("int").alias("r"),
                                                    (F.col("o_custkey") % 256).cast("int").alias("g"), ((F.col("o_orderkey") * 13) % 256).cast("int").alias("b"))
    return nearest_color(o, "r", "g", "b", "color", "color_rgb")


def _clock_rows(spark, sf_dir):
    return spark.sql("""SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' ELSE 'pl' END AS lang,
      o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_custkey % 60 AS INT), 0) AS ts FROM {o}""", o=spark_input(spark, sf_dir, "orders"))


def p11_localized_clock(spark, sf_dir):
    return _clock_rows(spark, sf_dir).select("o_orderkey", "lang", K.clock_line(F.col("ts"), F.col("lang")).alias("clock"))


def p12_draw_prompt_time(spark, sf_dir):
    return spark_input(spark, sf_dir, "customer").select("c_custkey", K.draw_time(42, ["c_custkey"]).alias("ts"))


def p13_rewrite_aliases(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("home_id", "pos", S.rewrite_aliases(F.col("entity_id")).alias("entity_id"))


def p14_format_attributes(spark, sf_dir):
    return S.format_attributes(_snapshot(spark, sf_dir)[0]).select("entity_id", F.array_join("shown", ";").alias("shown"))


def p15_format_entity_line(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    state = F.array_join(F.concat(F.array("state"), "shown"), ";")
    return rows.select("home_id", "pos", S.format_entity_line(F.col("entity_id"), F.col("friendly_name"), state).alias("line"))


def p16_slugify_names(spark, sf_dir):
    p = spark_input(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Bob's "), "p_name", F.lit(" A-"), "p_brand").alias("name"))
    return p.select("p_partkey", slug(F.col("name")).alias("synthetic"), slug(F.col("name"), drop_quotes=False, dashes=True).alias("translated"))


def p23_build_localized_prompt(spark, sf_dir):
    template = "<persona>\n<tools>, <services>, <area>\n<devices>:\n<current_date>\n<user_instruction>: "
    docs = spark_input(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang")).alias("lang"),
                                                          F.concat(F.lit(template), "text").alias("template"))
    docs = docs.withColumn("ts", F.expr("timestampadd(MINUTE, doc_id * 7777, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    return S.build_localized_prompt(docs, clock=K.live_clock(F.col("ts"), F.col("_lang"))).select("doc_id", F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("chars"))


def j6_enrich_entities(spark, sf_dir):
    rows = _snapshot(spark, sf_dir)[0]
    return rows.select("entity_id", "home_id", "state", "area_id", "area_name", F.concat_ws("|", "aliases").alias("aliases"))


def j7_exposed_domains(spark, sf_dir):
    _, states, exposed = _snapshot(spark, sf_dir)
    return S.exposed_domains(states, exposed)


def j8_explode_aliases(spark, sf_dir):
    return S.explode_aliases(_snapshot(spark, sf_dir)[0]).select("entity_id", "alias_pos", "friendly_name", "is_alias", "state")


def a2_entities_block(spark, sf_dir):
    rows = p15_format_entity_line(spark, sf_dir)
    return S.entities_block(rows, ["home_id"], "pos", "line", F.lit("de"))


def a3_prompt_by_area(spark, sf_dir):
    return S.prompt_by_area(_lines(spark, sf_dir), "home_id", "pos", F.lit("en"), F.lit("You are Al."), F.lit("The time is now"))


def w5_order_by_recency(spark, sf_dir):
    people = spark_input(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("home_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("entity_id"))
    moves = spark_input(spark, sf_dir, "events").join(people, "user_id").select("home_id", "entity_id", "ts")
    people = people.drop("user_id")
    return S.order_by_recency(people, moves, ["home_id"])


def w11_sort_tools(spark, sf_dir):
    parts = spark_input(spark, sf_dir, "part").withColumn("names", F.split(F.concat_ws(",", "p_name", "p_brand", "p_type"), "[, ]"))
    return parts.select("p_partkey", F.array_join(S.sort_tools(F.col("names")), ",").alias("tools"))


QUERIES = {f.__name__: f for f in (
    p2_split_entity_id, p10_nearest_named_color, p11_localized_clock, p12_draw_prompt_time, p13_rewrite_aliases, p14_format_attributes,
    p15_format_entity_line, p16_slugify_names, p23_build_localized_prompt, j6_enrich_entities, j7_exposed_domains, j8_explode_aliases,
    a2_entities_block, a3_prompt_by_area, w5_order_by_recency, w11_sort_tools)}

def _live(lang):
    """The live clock of one language in DuckDB."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    names = lambda table: "[" + ", ".join(q(n) for n in table[lang]) + "]"
    day, month = f"{names(fixed.LIVE_DAY_NAMES)}[isodow(ts)]", f"{names(fixed.LIVE_MONTH_NAMES)}[month(ts)]"
    marks = {"{h}": "strftime(ts, '%I')", "{H}": "strftime(ts, '%H')", "{m}": "strftime(ts, '%M')", "{a}": "strftime(ts, '%p')", "{day}": day, "{d}": "day(ts)::VARCHAR",
             "{dd}": "strftime(ts, '%d')", "{month}": month, "{y}": "year(ts)::VARCHAR"}
    text = q(fixed.LIVE_CLOCK_PATTERNS[lang])
    for mark, value in marks.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"WHEN '{lang}' THEN {text}"


COLORS = "colors AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', {r}, {g}, {b})" for o, n, r, g, b in fixed.color_rows()) + ") v(ord, name, r, g, b))"
_dist = lambda r, g, b: f"(c.r - {r}) * (c.r - {r}) + (c.g - {g}) * (c.g - {g}) + (c.b - {b}) * (c.b - {b})"
SNAP = COLORS + f""",
e AS (SELECT reg.*, domain || '.' || suffix AS entity_id, reg.state || coalesce(' ' || unit, '') AS full_state,
   n_name AS area_name, CAST(n_nationkey AS BIGINT) AS area_id
  FROM registry reg LEFT JOIN supplier ON s_suppkey = device_id LEFT JOIN nation ON n_nationkey = coalesce(entity_area, s_nationkey) WHERE exposed),
near AS (SELECT e.entity_id, arg_max(c.name, -({_dist('red', 'green', 'blue')}) * 1000 + c.ord) AS color FROM e, colors c WHERE red IS NOT NULL GROUP BY 1),
shown AS (SELECT e.*, list_filter([CASE WHEN red IS NOT NULL THEN color || ' (' || red || ', ' || green || ', ' || blue || ')' END,
    CASE WHEN brightness IS NOT NULL THEN CAST(trunc(brightness / 255.0::DOUBLE * 100) AS INT) || '%' END,
    CASE WHEN temperature_unit IS NOT NULL THEN temperature || ' ' || temperature_unit WHEN temperature IS NOT NULL THEN split_part(temperature, '.', 1) || CASE WHEN temperature::DOUBLE > 50 THEN ' F' ELSE ' C' END END,
    humidity || '%', media_title, 'vol=' || CAST(trunc(volume_level * 100) AS INT)], lambda x: x IS NOT NULL) AS attrs
  FROM e LEFT JOIN near USING (entity_id)),
names AS (SELECT shown.*, place * 4 + alias_pos AS pos, alias_pos, CASE alias_pos WHEN 0 THEN friendly_name ELSE list_filter([alias1, alias2], lambda x: x IS NOT NULL)[alias_pos] END AS nm
  FROM shown, (VALUES (0), (1), (2)) v(alias_pos) WHERE alias_pos <= (alias1 IS NOT NULL)::INT + (alias2 IS NOT NULL)::INT),
lines AS (SELECT *, entity_id || ' ''' || nm || ''' = ' || full_state || CASE WHEN len(attrs) > 0 THEN ';' || array_to_string(attrs, ';') ELSE '' END AS line FROM names)"""
S_ = with_inputs("registry", tail=SNAP)


def _case(table, f=lambda v: "'" + v.replace("'", "''") + "'", col="lang"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in table.items()) + " END"


_names = lambda v: "[" + ",".join("'" + x + "'" for x in v) + "]"
_replace_all = lambda text, lang: __import__("functools").reduce(lambda t, kv: f"replace({t}, '<{kv[0]}>', {_case(kv[1], col=lang)})", [
    ("persona", fixed.PERSONA_WORDS), ("devices", fixed.DEVICES_WORDS), ("services", fixed.SERVICES_WORDS), ("tools", fixed.TOOLS_WORDS),
    ("area", fixed.AREA_WORDS), ("user_instruction", fixed.INSTRUCTION_WORDS)], text)
_hour12 = "CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END"
ORACLES = {
    "p2_split_entity_id": with_inputs("registry") + """SELECT domain || '.' || suffix AS entity_id, domain, suffix,
      array_to_string(list_transform(regexp_extract_all(replace(suffix, '_', ' '), '[^A-Za-z]*[A-Za-z]*'), lambda x: regexp_extract(x, '^[^A-Za-z]*') || upper(regexp_extract(x, '[A-Za-z]')) || lower(regexp_extract(x, '[A-Za-z](.*)', 1))), '') AS friendly_name FROM registry""",
    "p10_nearest_named_color": "WITH " + COLORS + f""", q AS (SELECT o_orderkey, CAST(o_orderkey % 256 AS INT) AS r, CAST(o_custkey % 256 AS INT) AS g, CAST((o_orderkey * 13) % 256 AS INT) AS b FROM orders),
      d AS (SELECT DISTINCT r, g, b FROM q), h AS (SELECT d.r, d.g, d.b, arg_max(struct_pack(n := c.name, x := '(' || c.r || ', ' || c.g || ', ' || c.b || ')'), -({_dist('d.r', 'd.g', 'd.b')}) * 1000 + c.ord) AS s FROM d, colors c GROUP BY 1, 2, 3)
      SELECT o_orderkey, r, g, b, s.n AS color, s.x AS color_rgb FROM q JOIN h USING (r, g, b)""",
    "p11_localized_clock": f"""WITH q AS (SELECT o_orderkey, ['en','de','fr','es','pl'][o_custkey % 5 + 1] AS lang, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_custkey % 60 AS INT)) AS ts FROM orders),
      n AS (SELECT *, {_case(fixed.DAY_NAMES, _names)}[isodow(ts)] AS dn, {_case(fixed.MONTH_NAMES, _names)}[month(ts)] AS mn, hour(ts) || ':' || minute(ts) AS hm FROM q)
      SELECT o_orderkey, lang, {_case(fixed.CLOCK_WORDS)} || ' ' || CASE lang WHEN 'en' THEN {_hour12} || ':' || minute(ts) || CASE WHEN hour(ts) < 12 THEN ' AM on ' ELSE ' PM on ' END || dn || ', ' || mn || ' ' || day(ts) || ' ' || year(ts)
        WHEN 'pl' THEN hm || ' w ' || dn || ', ' || day(ts) || ' ' || mn || ' ' || year(ts) WHEN 'es' THEN hm || ' ' || dn || ', ' || day(ts) || ' de ' || mn || ' de ' || year(ts)
        ELSE hm || ' ' || dn || ', ' || day(ts) || ' ' || mn || ' ' || year(ts) END AS clock FROM n""",
    "p12_draw_prompt_time": f"""SELECT c_custkey, TIMESTAMP '2022-01-01' + to_days(CAST({sql_hash('c_custkey', "'day'")} % (DATE '2030-12-31' - DATE '2022-01-01' + 1) AS INT))
      + to_seconds({sql_hash('c_custkey', "'second'")} % 86401) AS ts FROM customer""",
    "p13_rewrite_aliases": S_ + "SELECT home_id, pos, CASE WHEN domain IN ('blinds', 'garage_door') THEN 'cover' ELSE domain END || '.' || suffix AS entity_id FROM names",
    "p14_format_attributes": S_ + "SELECT entity_id, array_to_string(attrs, ';') AS shown FROM shown",
    "p15_format_entity_line": S_ + "SELECT home_id, pos, line FROM lines",
    "p16_slugify_names": """SELECT p_partkey, lower('bobs_' || replace(p_name, ' ', '_') || '_a-' || p_brand) AS synthetic, lower('bob''s_' || replace(p_name, ' ', '_') || '_a_' || p_brand) AS translated FROM part""",
    "p23_build_localized_prompt": f"""WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN 'en' ELSE lang END AS lg FROM documents),
      c AS (SELECT *, CASE lg {' '.join(_live(l) for l in fixed.PROMPT_LANGUAGES)} END AS now FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7777 AS BIGINT)) AS ts FROM q)),
      r AS (SELECT doc_id, {_replace_all("('<persona>' || chr(10) || '<tools>, <services>, <area>' || chr(10) || '<devices>:' || chr(10) || now || chr(10) || '<user_instruction>: ' || text)", 'lg')} AS prompt FROM c)
      SELECT doc_id, md5(prompt) AS digest, length(prompt) AS chars FROM r""",
    "j6_enrich_entities": S_ + "SELECT entity_id, home_id, full_state AS state, area_id, area_name, concat_ws('|', alias1, alias2) AS aliases FROM e",
    "j7_exposed_domains": S_ + "SELECT DISTINCT domain FROM registry WHERE exposed",
    "j8_explode_aliases": S_ + "SELECT entity_id, CAST(alias_pos AS INT) AS alias_pos, nm AS friendly_name, alias_pos > 0 AS is_alias, full_state AS state FROM names",
    "a2_entities_block": S_ + "SELECT home_id, 'Geräte:' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS block FROM lines GROUP BY 1",
    "a3_prompt_by_area": S_ + """, byarea AS (SELECT home_id, area_name, CASE WHEN area_name IS NULL THEN '' ELSE '## Area: ' || area_name || chr(10) END
        || string_agg(line || CASE WHEN area_name IS NOT NULL AND len(attrs) = 0 THEN ';' ELSE '' END, chr(10) ORDER BY pos) AS t FROM lines GROUP BY home_id, area_name)
      SELECT home_id, 'You are Al.' || chr(10) || 'Devices:' || chr(10) || string_agg(t, chr(10) ORDER BY area_name NULLS FIRST) || chr(10) || 'The time is now' AS prompt FROM byarea GROUP BY 1""",
    "w5_order_by_recency": """SELECT c_nationkey AS home_id, c_name AS entity_id, last_update, row_number() OVER (PARTITION BY c_nationkey ORDER BY last_update NULLS FIRST, c_name) AS place
      FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_update FROM events GROUP BY 1) ON user_id = c_custkey""",
    "w11_sort_tools": "SELECT p_partkey, array_to_string(list_sort(string_split(replace(p_name, ' ', ',') || ',' || replace(p_brand, ' ', ',') || ',' || replace(p_type, ' ', ','), ',')), ',') AS tools FROM part",
}
