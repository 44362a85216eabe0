"""Device-state snapshots and the prompts rendered from them."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.colors import nearest_color
from dialoom.functions.scan import scan
from dialoom.functions.text import domain_of, lookup
from dialoom.operators.messages import join_pieces


def enrich_entities(states: DataFrame, exposed: DataFrame, entities: DataFrame, devices: DataFrame, areas: DataFrame) -> DataFrame:
    """Exposed states with unit, aliases and area; an entity's own area beats its device's.

    states(entity_id, state, attributes, ...), exposed(entity_id), entities(entity_id, device_id,
    area_id, unit, aliases), devices(device_id, area_id), areas(area_id, name).
    """
    own = entities.select("entity_id", "device_id", F.col("area_id").alias("_own"), "unit", "aliases")
    dev = devices.select("device_id", F.col("area_id").alias("_dev"))
    known = areas.select("area_id", F.col("name").alias("area_name"))
    return (states.join(exposed.select("entity_id"), "entity_id", "left_semi")
            .join(own, "entity_id", "left").join(dev, "device_id", "left")
            .withColumn("area_id", F.coalesce("_own", "_dev"))
            .join(known, "area_id", "left")
            .withColumn("state", F.when(F.coalesce("unit", F.lit("")) != "", F.concat_ws(" ", "state", "unit")).otherwise(F.col("state")))
            .withColumn("area_id", F.when(F.col("area_name").isNotNull(), F.col("area_id")))
            .drop("_own", "_dev", "unit", "device_id"))


def exposed_domains(states: DataFrame, exposed: DataFrame) -> DataFrame:
    return states.join(exposed.select("entity_id"), "entity_id", "left_semi") \
        .select(domain_of(F.col("entity_id")).alias("domain")).distinct()


def explode_aliases(df: DataFrame, name="friendly_name", aliases="aliases") -> DataFrame:
    """The base row followed by one row per alias (`alias_pos` 0 is the base)."""
    names = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    keep = [c for c in df.columns if c not in (name, aliases)]
    return df.select(*keep, F.posexplode(names).alias("alias_pos", name)) \
        .withColumn("is_alias", F.col("alias_pos") > 0)


def format_attributes(df: DataFrame, order=tuple(fixed.PROMPT_ATTRIBUTES), attributes="attributes", out="shown") -> DataFrame:
    """Add the printed attributes, ARRAY<STRING> in fixed order, absent ones left out.

    Values come as MAP<STRING,STRING>; `x_unit` is the unit of `x` and wins over the built-in forms.
    """
    get = lambda k: F.try_element_at(F.col(attributes), F.lit(k))
    number = lambda k: get(k).try_cast("double")
    channels = F.regexp_extract_all(get("rgb_color"), F.lit(r"(\d+)"), F.lit(1))
    for i, c in enumerate("rgb"):
        df = df.withColumn(f"_c{c}", F.try_element_at(channels, F.lit(i + 1)).try_cast("int"))
    df = nearest_color(df, "_cr", "_cg", "_cb", "_color")
    forms = {
        "temperature": F.concat_ws(" ", number("temperature").cast("int").cast("string"),
                                   F.when(number("temperature") > 50, "F").otherwise("C")),
        "rgb_color": F.concat(F.col("_color"), F.lit(" ("), F.concat_ws(", ", "_cr", "_cg", "_cb"), F.lit(")")),
        "volume_level": F.concat(F.lit("vol="), (number("volume_level") * 100).cast("int").cast("string")),
        "brightness": F.concat((number("brightness") / F.lit(255.0).cast("double") * 100).cast("int").cast("string"), F.lit("%")),
        "humidity": F.concat(get("humidity"), F.lit("%")),
    }
    shown = []
    for k in order:
        unit = get(f"{k}_unit")
        shown.append(F.when(get(k).isNull(), F.lit(None)).when(F.coalesce(unit, F.lit("")) != "", F.concat_ws(" ", get(k), unit))
                     .otherwise(forms.get(k, get(k))))
    return df.withColumn(out, F.filter(F.array(*shown), lambda x: x.isNotNull())).drop("_cr", "_cg", "_cb", "_color")


def format_entity_line(entity_id: Column, name: Column, state: Column) -> Column:
    return F.concat(entity_id, F.lit(" '"), F.coalesce(name, F.lit("None")), F.lit("' = "), state)


def rewrite_aliases(text: Column) -> Column:
    """Blinds and garage doors are covers outside the device pile."""
    return F.replace(F.replace(text, F.lit("blinds."), F.lit("cover.")), F.lit("garage_door."), F.lit("cover."))


def entities_block(lines: DataFrame, keys, pos, line, lang: Column) -> DataFrame:
    """Header and ordered lines as one text per key."""
    body = join_pieces(lines, keys, pos, line, "_body", "\n")
    return body.select(*keys, F.concat(lookup(lang, fixed.DEVICES_WORDS), F.lit(":\n"), "_body").alias("block"))


def prompt_by_area(lines: DataFrame, home, pos, lang: Column, persona: Column, clock: Column) -> DataFrame:
    """One prompt per home: entities without area first, then areas by name.

    Rows hold entity_id, friendly_name, state, shown ARRAY<STRING>, area_name. A row without area
    has no trailing `;` when nothing else is shown, a row with area always has one.
    """
    attrs = F.array_join("shown", ";")
    plain = F.concat("state", F.when(F.size("shown") > 0, F.concat(F.lit(";"), attrs)).otherwise(""))
    state = F.when(F.col("area_name").isNull(), plain).otherwise(F.concat("state", F.lit(";"), attrs))
    rows = lines.withColumn("_line", format_entity_line(F.col("entity_id"), F.col("friendly_name"), state))
    by_area = rows.groupBy(home, "area_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col(pos).alias("p"), F.col("_line").alias("t")))), lambda x: x["t"]), "\n").alias("_text"))
    header = F.when(F.col("area_name").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("## "), lookup(lang, fixed.AREA_WORDS), F.lit(": "), "area_name", F.lit("\n")))
    sections = by_area.withColumn("_section", F.concat(header, "_text"))
    blocks = F.sort_array(F.collect_list(F.struct(F.col("area_name").isNotNull().alias("h"), F.coalesce("area_name", F.lit("")).alias("a"),
                                                  F.col("_section").alias("t"))))
    prompt = sections.groupBy(home).agg(F.array_join(F.transform(blocks, lambda x: x["t"]), "\n").alias("_devices"))
    return prompt.select(home, F.concat(persona, F.lit("\n"), lookup(lang, fixed.DEVICES_WORDS), F.lit(":\n"),
                                                "_devices", F.lit("\n"), clock).alias("prompt"))


def order_by_recency(entities: DataFrame, updates: DataFrame, scope, entity="entity_id", ts="ts") -> DataFrame:
    """Entities (named by text) with their last update and `place`: never updated first by name, then oldest to newest."""
    latest = updates.groupBy(*scope, entity).agg(F.max(ts).alias("last_update"))
    rows = entities.join(latest, [*scope, entity], "left")
    return scan(rows, scope, [F.asc_nulls_first("last_update"), F.col(entity)], sums={"place": F.lit(1)})


def build_localized_prompt(df: DataFrame, template="template", lang="lang", clock: Column | None = None, out="prompt") -> DataFrame:
    """Replace the seven text markers in the words of the row's language; unknown languages use English."""
    known = F.when(F.col(lang).isin(*fixed.PROMPT_LANGUAGES), F.col(lang)).otherwise("en")
    words = {"persona": fixed.PERSONA_WORDS, "current_date": None, "devices": fixed.DEVICES_WORDS, "services": fixed.SERVICES_WORDS,
             "tools": fixed.TOOLS_WORDS, "area": fixed.AREA_WORDS, "user_instruction": fixed.INSTRUCTION_WORDS}
    text = F.col(template)
    for mark, table in words.items():
        value = lookup(F.col("_lang"), table) if table else clock
        if value is not None:
            text = F.replace(text, F.lit(f"<{mark}>"), value)
    return df.withColumn("_lang", known).withColumn(out, text).drop("_lang")


def sort_tools(names: Column) -> Column:
    return F.sort_array(names)
