"""Seeded sampling: parameters, states, devices, responses and dataset mixes.

Every draw is a hash of row keys, so results do not depend on partitioning, retries or order.
Picks from a table go through a dense index: the drawing row computes `hash % n` and meets the
picked row in an equi join, which moves each row once however large the table is.
"""
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.functions.colors import nearest_color
from dialoom.functions.draws import draw, draw_choice, draw_fraction, draw_hash, draw_int
from dialoom.functions.ordered import dense_index, number_all
from dialoom.functions.scan import scan
from dialoom.functions.stage import stage
from dialoom.functions.text import domain_of, lookup, placeholders, suffix_of

# fixed values: strides for walking an index; a prime that does not divide n visits all n places
STRIDES = [1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121, 1000133, 1000151, 1000159, 1000171]
SIMILAR = 0.4  # fixed value: names at least this alike count as the same device
POOL_SENT = 256 << 20  # bytes of a pile that is sent around whole
STEPS_A_TASK = 1 << 18


def by_language(*tables: DataFrame) -> list:
    """["language"] if all of the tables have that column: piles are kept and drawn from per language."""
    return ["language"] if all("language" in t.columns for t in tables) else []


def index_pile(pile: DataFrame, value: str) -> DataFrame:
    """The distinct values of a pile, numbered for drawing, per language where the pile has one."""
    if by_language(pile):
        return dense_index(pile.select("language", value).distinct(), ["language"], value).drop("n")
    return number_all(pile.select(value).distinct(), value)


def draw_from_pile(df: DataFrame, indexed: DataFrame, value: str, seed, keys, purpose, out) -> DataFrame:
    """Add one uniformly drawn value of a numbered pile, of the row's language where both have one; NULL from an empty pile."""
    lang = by_language(df, indexed)
    pile = indexed.select(*lang, F.col("idx").alias("_idx"), F.col(value).alias(out))
    if lang:  # one count per language, looked up in the row
        counts = indexed.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
        n = F.try_element_at(counts.select(F.map_from_entries(F.collect_list(F.struct("language", "n")))).scalar(), F.col("language"))
    else:
        n = indexed.select(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn("_n", n).withColumn("_idx", F.when(F.col("_n") > 0, draw(seed, keys, purpose, F.col("_n")))).join(pile, [*lang, "_idx"], "left").drop("_idx", "_n")


def parameter(kind: str, seed, keys) -> Column:
    """A drawn value of a built-in kind as printed text."""
    k = f"p:{kind}"
    if kind in fixed.INT_RANGES:
        return draw_int(seed, keys, k, *fixed.INT_RANGES[kind]).cast("string")
    if kind in ("red", "green", "blue"):
        return draw(seed, keys, k, 256).cast("string")
    if kind == "volume":
        return (draw(seed, keys, k, 101) / F.lit(100.0).cast("double")).cast("string")
    if kind == "remaining":
        return F.concat(F.lpad(draw(seed, keys, k + "h", 4).cast("string"), 2, "0"), F.lit(":"),
                        draw(seed, keys, k + "m", 61).cast("string"), F.lit(":"), draw(seed, keys, k + "s", 61).cast("string"))
    choices = {"fan_mode": fixed.FAN_MODES, "preset_mode": fixed.PRESET_MODES, "hvac_mode": fixed.HVAC_MODES}
    if kind not in choices:
        raise ValueError(f"no built-in draw for parameter {kind}")
    return draw_choice(seed, keys, k, choices[kind])


def draw_weighted_state(device_type: Column, seed, keys) -> Column:
    """A state of the device type, drawn by weight; climate has no weighted states."""
    at = draw_fraction(seed, keys, "state")
    cases = F.when(device_type == "todo", F.floor(at * fixed.TODO_STATES).cast("string"))
    for name, weights in fixed.STATE_WEIGHTS.items():
        total, running = sum(w for _, w in weights), 0.0
        pick = F.when(F.lit(False), F.lit(""))
        for state, w in weights[:-1]:
            running += w
            pick = pick.when(at * F.lit(total) < F.lit(running), state)
        cases = cases.when(device_type == name, pick.otherwise(weights[-1][0]))
    return cases


def compose_state(df: DataFrame, seed, keys, type_col="type", media_col="media", attributes=tuple(fixed.CONTEXT_ATTRIBUTES),
                  out="state") -> DataFrame:
    """Add the full state text of a device of the row's type, extra parts joined with `;`."""
    kind = F.col(type_col)
    shown = set(attributes)
    chance = lambda p, share: draw_fraction(seed, keys, p) < F.lit(share)
    when = lambda cond, value: F.when(cond, value)
    colored = (kind == "light") & chance("light:color", 0.5) & F.lit("rgb_color" in shown)
    df = df.withColumns({f"_{c}": when(colored, parameter(c, seed, keys).cast("int")) for c in ("red", "green", "blue")})
    df = nearest_color(df, "_red", "_green", "_blue", "_color")
    rgb = F.concat(F.col("_color"), F.lit(" ("), F.concat_ws(", ", "_red", "_green", "_blue"), F.lit(")"))
    df = df.withColumn("_base", F.when(kind == "climate", parameter("hvac_mode", seed, keys)).otherwise(draw_weighted_state(kind, seed, keys)))
    base = F.col("_base")
    climate, media = kind == "climate", kind == "media_player"
    temp = F.when(draw_fraction(seed, keys, "climate:unit") > 0.5, F.concat(parameter("temp_f", seed, keys), F.lit("F"))) \
        .otherwise(F.concat(parameter("temp_c", seed, keys), F.lit("C")))
    parts = [
        base, when(colored, rgb),
        when((kind == "light") & chance("light:brightness", 0.7) & F.lit("brightness" in shown), F.concat(parameter("brightness", seed, keys), F.lit("%"))),
        when(climate & F.lit("fan_mode" in shown), parameter("fan_mode", seed, keys)),
        when(climate & F.lit("temperature" in shown), temp),
        when(climate & F.lit("humidity" in shown), F.concat(parameter("humidity", seed, keys), F.lit("%"))),
        when(climate & chance("climate:preset", 0.8) & F.lit("preset_mode" in shown), parameter("preset_mode", seed, keys)),
        when(media & base.isin("playing", "paused", "buffering", "on") & F.lit("media_title" in shown), F.col(media_col)),
        when(media & (base != "off") & F.lit("volume_level" in shown), F.concat(F.lit("vol="), parameter("volume", seed, keys), F.lit("%"))),
    ]
    return df.withColumn(out, F.concat_ws(";", *parts)).drop("_red", "_green", "_blue", "_color", "_base")


def stack_devices(devices: DataFrame, supported=tuple(fixed.DEVICE_DOMAINS)):
    """(devices numbered inside their type, and language, with the number of such devices; devices of unknown types)."""
    typed = devices.withColumn("type", domain_of(F.col("device_name")))
    known = typed.filter(F.col("type").isin(*supported))
    return dense_index(known, [*by_language(devices), "type"], "device_name"), typed.filter(~F.col("type").isin(*supported))


def pick_target_devices(slots: DataFrame, stacks: DataFrame, seed, keys) -> DataFrame:
    """One uniform device of the slot's type (and language) per row, with replacement."""
    lang = by_language(slots, stacks)
    # a row per supported type and language
    sizes = F.broadcast(stacks.select(*lang, "type", "n").distinct())
    drawn = slots.join(sizes, [*lang, "type"]).withColumn("idx", draw(seed, keys, "device", F.col("n"))).drop("n")
    own = stacks.drop("n", *([] if lang else ["language"]))
    return drawn.join(own, [*lang, "type", "idx"]).drop("idx")


def likeness_bound(a: Column, b: Column) -> Column:
    """At least the matching-block ratio of two texts: twice the characters they have in common, whatever their order, by their lengths together."""
    letters = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * common / both)


def likeness(limit: float):
    """A function of two texts: whether difflib's matching-block ratio is `limit` or more. It counts no further than that takes.

    Blocks are taken as there: the longest, then the first in `a`, then the first in `b`, and the same left and right of it. It goes to tasks whole,
    which need not know this module.
    """
    def alike(a, b):
        total = len(a) + len(b)
        if not total or len(b) >= 200:  # from there on difflib leaves frequent characters out
            from difflib import SequenceMatcher
            return SequenceMatcher(None, a, b).ratio() >= limit
        got, most = 0, min(len(a), len(b))  # characters matched, and how many it can be at most
        spans = [(0, len(a), 0, len(b))]
        while True:
            if 2.0 * got / total >= limit:
                return True
            if not spans or 2.0 * most / total < limit:
                return False
            alo, ahi, blo, bhi = spans.pop()
            size = i = j = 0
            for at in range(alo, ahi):
                while at + size < ahi and (found := b.find(a[at:at + size + 1], blo, bhi)) >= 0:
                    size, i, j = size + 1, at, found
                if at + size >= ahi:
                    break
            most -= min(ahi - alo, bhi - blo)
            if size:
                sides = [x for x in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)) if x[0] < x[1] and x[2] < x[3]]
                got, most, spans = got + size, most + size + sum(min(x[1] - x[0], x[3] - x[2]) for x in sides), spans + sides

    return alike


def alike_to_any(names: Column, name: Column, limit: float) -> Column:
    """Whether the matching-block ratio of one of the `names` (without nulls) to `name` is `limit` or more."""
    alike = likeness(limit)

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some, one in batches:
            asked = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(some), 0), False).to_numpy(zero_copy_only=False))
            found = np.zeros(len(one), bool)
            for i, few, b in zip(asked.tolist(), some.take(pa.array(asked)).to_pylist(), one.take(pa.array(asked)).to_pylist()):
                found[i] = b is not None and any(alike(a, b) for a in few)
            yield pa.array(found)

    return run(names, name)


def alike_names(pairs: DataFrame, a: str, b: str, limit: float) -> DataFrame:
    """The distinct pairs whose matching-block ratio is `limit` or more; only those that the bound lets through are matched."""
    length = F.greatest(F.length(a) + F.length(b), F.lit(1))
    near = pairs.select(a, b).distinct().where(F.lit(2.0) * F.least(F.length(a), F.length(b)) / length >= F.when(F.length(a) + F.length(b) == 0, 0.0).otherwise(limit))
    near = near.where(likeness_bound(F.col(a), F.col(b)) >= limit)
    return near.where(alike_to_any(F.array(a), F.col(b), limit))


def _with_first_length(start: DataFrame, pool: DataFrame, lang, similar) -> DataFrame:
    """Add `_length`: how far a walk goes at first: as far as the need takes if all devices of the avoided types are refused, and somewhat more.

    It is at most twice the need and 16, whatever the types; whoever is left short then walks on.
    """
    key = lambda language, kind: F.concat_ws("\u0001", language, kind)
    counts = pool.groupBy(*lang, "type").agg(F.count(F.lit(1)).alias("n"))  # a row per type and language
    entry = F.struct(key(F.col("language") if lang else F.lit(""), F.coalesce("type", F.lit(""))).alias("k"), F.col("n"))
    start = start.withColumn("_types", counts.select(F.map_from_entries(F.collect_list(entry))).scalar())
    kinds = F.filter("_near", lambda t: t == "climate") if similar is None else F.col("_near")
    of = lambda t: F.coalesce(F.try_element_at("_types", key(F.col("language") if lang else F.lit(""), t)), F.lit(0).cast("bigint"))
    refused = F.coalesce(F.aggregate(kinds, F.lit(0).cast("bigint"), lambda n, t: n + of(t)), F.lit(0).cast("bigint"))
    need = F.ceil(F.col("_want") * F.col("_size") * F.lit(1.1) / F.greatest(F.col("_size") - refused, F.lit(1))).cast("bigint") + 12
    return start.withColumn("_length", F.least(need, 2 * F.col("_want") + 16, F.col("_size"))).drop("_types")


def sent_whole(table: DataFrame) -> DataFrame:
    """The table with the hint to send it around, if its texts and 64 bytes a row are at most POOL_SENT and an eighth of a heap; else to deal it out.

    Rows that are made for it by an explode look few to the planner, so it isn't left to choose.
    """
    spark = table.sparkSession
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"]
    taken = table.agg(F.sum(reduce(lambda x, y: x + y, texts, F.lit(64)).cast("bigint"))).first()[0] or 0
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):  # executors have heaps of their own
        heap = min(heap, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(spark.conf.get("spark.executor.memory", "1g")) << 20)
    return F.broadcast(table) if taken <= min(POOL_SENT, heap // 8) else table.hint("shuffle_hash")


def tasks_of(spark, steps: int) -> int:
    """Tasks for so many steps of walks: a few examples make very many, so they are dealt by steps and not by bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + steps // STEPS_A_TASK)


def _places(rows: DataFrame, sizes) -> Column:
    """One number for `idx` in the pile of the row's language: a join on a number needs less memory than one on a text and a number."""
    if sizes is None:
        return F.col("idx")
    languages = F.map_keys(sizes)
    return F.col("idx") * F.size(languages) + F.array_position(languages, F.col("language")) - 1


def _refused(rows: DataFrame, pool: DataFrame, sizes, similar) -> DataFrame:
    """(_example, _k ARRAY): which of the steps _done to _length - 1 meet a device that the example can't take. Rows are dealt by `_example`."""
    lang = by_language(rows)
    near = F.transform("_avoid", domain_of)
    avoid = [F.array_contains(near, "climate").alias("_no_climate"), F.array_distinct(near).alias("_near"),
             F.col("_avoid") if similar is None else F.transform("_avoid", lambda a: F.struct(domain_of(a).alias("type"), a.alias("name"))).alias("_by")]
    # two selects, as whatever stands beside an explode is computed for each of its rows
    rows = rows.where("_done < _length").select("_example", *lang, "_from", "_step", "_size", "_done", "_length", *avoid)
    steps = rows.select("*", F.explode(F.sequence("_done", F.col("_length") - 1)).alias("_k"))
    steps = steps.withColumn("idx", (F.col("_from") + F.col("_k") * F.col("_step")) % F.col("_size")).withColumn("_place", _places(steps, sizes))
    met = steps.drop(*lang, "_from", "_step", "_size", "_done", "_length", "idx").join(pool.select("_place", "device_name", "type"), "_place", "left")
    barred = F.col("device_name").isNull() | ~F.coalesce(~(F.col("_no_climate") & (F.col("type") == "climate")), F.lit(False))
    if similar is None:
        met = met.filter(barred | ~F.coalesce(~F.array_contains("_avoid", F.col("device_name")), F.lit(False)))
    else:
        # nearly all steps end here: names are compared only with those of their own type
        met = met.withColumn("_barred", barred).filter(F.col("_barred") | F.array_contains("_near", F.col("type")))
        met = met.withColumn("_close", F.transform(F.filter("_by", lambda x: x["type"] == F.col("type")), lambda x: x["name"]))
        met = met.withColumn("_alike", alike_to_any(F.when(~F.col("_barred"), F.col("_close")), suffix_of(F.col("device_name")), similar)).filter(F.col("_barred") | F.col("_alike"))
    return met.groupBy("_example").agg(F.collect_list("_k").alias("_k"))


def sample_context_devices(examples: DataFrame, devices: DataFrame, seed, keys, max_devices=128, avoid="avoid", similar=SIMILAR, carry=(), tasks=None) -> DataFrame:
    """Distinct context devices per example (of its language): n uniform in 2..max, `rank` 0..n-1, with the example's columns `carry`.

    An example walks the device index with a stride coprime to its size, so no place repeats.
    Devices alike to an avoided name (ARRAY<STRING> of device names) of their own type are
    rejected, as are further climate devices when one is avoided; with `similar=None` only the
    avoided names themselves are. A first walk of somewhat more than the need serves nearly every example. Those
    it leaves short walk four times as far, and so on, until they have enough or have seen all.

    The walks are gone twice. The first time finds the refused steps, few and by number alone, which are written; the second time steps over them
    and names the devices. Its rows are in no file: they come from the examples, dealt by `keys` over `tasks` tasks, as they are read, and stay in the
    task of their example where the pile of devices is small enough to be sent around (`sent_whole`).
    """
    lang = by_language(examples, devices)
    spark = examples.sparkSession
    pool = devices.select(*lang, "device_name", "description")
    pool = dense_index(pool, lang, "device_name").drop("n") if lang else number_all(pool, "device_name")
    sizes = None
    if lang:  # sorted, so that a language has the same place in it wherever it is looked up
        counts = devices.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.select(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n"))))).scalar()
        size = F.coalesce(F.try_element_at(sizes, F.col("language")), F.lit(0))
    else:
        size = F.lit(devices.count())
    pool = stage(pool.withColumn("type", domain_of(F.col("device_name"))).withColumn("_place", _places(pool, sizes)))
    start = examples.select(*dict.fromkeys([*keys, *lang, *carry]), F.col(avoid).alias("_avoid")).withColumn("_size", size.cast("bigint")).filter("_size > 0")
    start = start.withColumns({"_want": F.least(draw_int(seed, keys, "context:n", 2, max_devices), F.col("_size")), "_near": F.array_distinct(F.transform("_avoid", domain_of))})
    start = _with_first_length(start, pool, lang, similar).drop("_near")
    start = stage(start.withColumn("_example", F.monotonically_increasing_id()))  # staged, so the numbers stay

    def directed(rows):
        """With start and stride, which are drawn where they are used, as they take more room than all the rest."""
        strides = F.filter(F.array(*[F.lit(s).cast("bigint") for s in STRIDES]), lambda s: F.col("_size") % s != 0)  # a prime that is no divisor is coprime
        return rows.withColumn("_strides", strides).withColumns({
            "_from": draw(seed, keys, "context:from", F.col("_size")),
            "_step": F.element_at("_strides", (draw(seed, keys, "context:step", F.size("_strides")) + 1).cast("int")) % F.col("_size")}).drop("_strides")

    pool = sent_whole(pool.drop(*lang, "idx"))

    parts, left = [], start.withColumns({"_done": F.lit(0).cast("bigint"), "_bad": F.array().cast("array<bigint>")})
    while True:
        steps = left.agg(F.sum(F.col("_length") - F.col("_done"))).first()[0] or 0
        dealt = left.repartition(tasks_of(spark, steps), "_example")
        found = stage(_refused(directed(dealt), pool, sizes, similar))
        walked = left.join(found, "_example", "left").withColumn("_bad", F.concat("_bad", F.coalesce("_k", F.array().cast("array<bigint>")))).drop("_k")
        enough = (F.col("_length") - F.size("_bad") >= F.col("_want")) | (F.col("_length") >= F.col("_size"))
        parts.append(walked.filter(enough))
        left = walked.filter(~enough).withColumns({"_done": F.col("_length"), "_length": F.least(4 * F.col("_length"), F.col("_size"))})
        left = stage(left)
        if left.isEmpty():
            break
    kept = list(dict.fromkeys([*keys, *lang, *carry]))
    walked = reduce(DataFrame.unionByName, parts).select(*kept, "_size", "_want", "_length", "_bad")
    walked = directed(walked.repartition(tasks or tasks_of(spark, start.agg(F.sum("_want")).first()[0] or 0), *keys))
    taken = F.slice(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("_length") - 1), F.col("_bad")), 1, F.col("_want").cast("int"))
    steps = walked.select(*kept, "_from", "_step", "_size", F.posexplode(taken).alias("rank", "_k"))
    steps = steps.withColumn("idx", (F.col("_from") + F.col("_k") * F.col("_step")) % F.col("_size")).withColumn("_place", _places(steps, sizes))
    return steps.join(pool, "_place").select(*keys, "rank", "device_name", "description", "type", *[c for c in carry if c not in keys])


def insert_at_position(lines: Column, targets: Column, seed, keys) -> Column:
    """Put each target (a struct with `slot` and `line`) at a uniform place of the growing list."""
    def put(acc, t):
        at = draw(seed, keys, F.concat(F.lit("insert"), t["slot"].cast("string")), F.size(acc) + 1)
        return F.array_insert(acc, (at + 1).cast("int"), t["line"])
    return F.aggregate(targets, lines, put)


def tools_per_example(types: Column, attributes=tuple(fixed.CONTEXT_ATTRIBUTES)) -> Column:
    """Tools of the device types present, without repeats; some need an exposed attribute."""
    shown = set(attributes)
    open_rules = [(t, tool) for t, tool, needs in fixed.TOOLS_BY_TYPE if not needs or shown & set(needs)]
    rules = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(tool).alias("tool")) for t, tool in open_rules])
    return F.array_distinct(F.transform(F.filter(rules, lambda r: F.array_contains(types, r["t"])), lambda r: r["tool"]))


RESPONSE_KEY = ["language", "service", "persona", "short", "contains_vars"]


def index_responses(responses: DataFrame) -> DataFrame:
    """Responses with their placeholder key, numbered inside language, service, persona, length and key."""
    keyed = responses.withColumn("contains_vars", placeholders(F.col("response_starting"))) \
        .withColumn("_name", F.concat_ws("\u0001", "response_starting", "response_confirmed"))
    return dense_index(keyed, RESPONSE_KEY, "_name").drop("_name")


def pick_response(wants: DataFrame, indexed: DataFrame, seed, keys) -> DataFrame:
    """Two independent picks: a starting and a confirming text. Rows without any response drop out."""
    sizes = indexed.select(*RESPONSE_KEY, "n").distinct()
    drawn = wants.join(sizes, RESPONSE_KEY).withColumns({
        "_i": draw(seed, keys, "starting", F.col("n")), "_j": draw(seed, keys, "confirmed", F.col("n"))}).drop("n")
    one = indexed.select(*RESPONSE_KEY, F.col("idx").alias("_i"), "response_starting")
    two = indexed.select(*RESPONSE_KEY, F.col("idx").alias("_j"), "response_confirmed")
    return drawn.join(one, [*RESPONSE_KEY, "_i"]).join(two, [*RESPONSE_KEY, "_j"]).drop("_i", "_j")


def report_missing_responses(wants: DataFrame, indexed: DataFrame) -> DataFrame:
    """Distinct wanted keys that no response serves, sorted."""
    return wants.select(*RESPONSE_KEY).distinct().join(indexed.select(*RESPONSE_KEY).distinct(), RESPONSE_KEY, "left_anti") \
        .orderBy(*RESPONSE_KEY)


def cross_personas(rows: DataFrame, personas: DataFrame) -> DataFrame:
    """Every row once per persona of its language; a language has a handful of them, so they travel as an array."""
    names = F.sort_array(F.collect_set("persona"))
    if by_language(rows, personas):
        table = personas.groupBy("language").agg(names.alias("p")).select(F.map_from_entries(F.collect_list(F.struct("language", "p")))).scalar()
        return rows.select("*", F.explode(F.try_element_at(table, F.col("language"))).alias("persona"))
    return rows.select("*", F.explode(personas.select(names.alias("p")).scalar()).alias("persona"))


def expand_mix_factors(rows: DataFrame, factors: dict, seed, keys, kind="kind") -> DataFrame:
    """Copies per row by its kind's factor: whole numbers repeat, a share below 1 keeps by chance."""
    factor = lookup(F.col(kind), {k: str(v) for k, v in factors.items()}).cast("double")
    copies = F.when(factor >= 1, F.floor(factor)).when(draw_fraction(seed, keys, "factor") < factor, 1).otherwise(0).cast("int")
    return rows.withColumn("_n", copies).filter(F.col("_n") > 0) \
        .select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def mix_report(entries: DataFrame, dims=("language", "persona", "kind")) -> DataFrame:
    return entries.cube(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("rows"))


def expand_multiplier(rows: DataFrame, multiplier="multiplier") -> DataFrame:
    """Repeat each row `multiplier` times; text that is no whole number fails the job."""
    n = F.col(multiplier).cast("string").try_cast("int")
    n = F.coalesce(n, F.raise_error(F.concat(F.lit("bad multiplier: "), F.coalesce(F.col(multiplier).cast("string"), F.lit("NULL")))).cast("int"))
    return rows.withColumn("_n", n).filter(F.col("_n") > 0) \
        .select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def explode_compound_templates(templates: DataFrame) -> DataFrame:
    """One row per device slot of a `|`-joined template, slot counted from 0."""
    types, services = F.split("device_type", r"\|"), F.split("service", r"\|")
    pairs = F.zip_with(types, services, lambda t, s: F.struct(t.alias("type"), F.concat(t, F.lit("."), s).alias("service_name")))
    # the shorter list ends the pairing
    pairs = F.filter(pairs, lambda p: p["type"].isNotNull() & p["service_name"].isNotNull())
    keep = [c for c in templates.columns if c not in ("device_type", "service")]
    return templates.select(*keep, F.size(types).alias("n_slots"), F.posexplode(pairs).alias("slot", "_p")) \
        .select(*keep, "n_slots", "slot", "_p.type", "_p.service_name")


def map_service_to_tool(rows: DataFrame, service="service_name"):
    """(rows with tool_name, rows whose action no tool serves)."""
    with_tool = rows.withColumn("tool_name", lookup(suffix_of(F.col(service)), fixed.SERVICE_TO_TOOL))
    return with_tool.filter(F.col("tool_name").isNotNull()), with_tool.filter(F.col("tool_name").isNull()).drop("tool_name")


def join_sub_answers(starting: Column, confirmed: Column, and_words) -> tuple:
    """(starting parts joined by spaces, the confirming parts once per and-word joined by it)."""
    first = F.trim(F.array_join(starting, " "))
    variants = F.transform(and_words, lambda w: F.call_function("array_join", confirmed, F.concat(F.lit(" "), w, F.lit(" "))))
    return first, F.array_join(variants, " ")


def merge_external_set(own_train: DataFrame, own_test: DataFrame, external: DataFrame, seed, key, test_share=0.1):
    """(train, test): the external set split by hash and appended; order by `shuffle_key` to mix."""
    held = draw_fraction(seed, [key], "split") < F.lit(test_share)
    mixed = lambda own, part: own.unionByName(part, allowMissingColumns=True).withColumn("shuffle_key", draw_hash(seed, [key], "shuffle"))
    return mixed(own_train, external.filter(~held)), mixed(own_test, external.filter(held))


def shuffled_shards(rows: DataFrame, seed, keys, shards: int) -> DataFrame:
    """All rows in one seeded order: `position` from 0, and `shard`, 0 to shards - 1, of which no two differ by more than a row.

    The order depends on the seed and the keys alone, not on partitions, files or retries: it is that of two 32-bit hashes
    of the keys, then of the keys themselves. Rows with equal keys stand beside each other in any order. The rows are dealt
    out by ranges of the hashes, so every task gets its share; no task sees all. Writing with partitionBy("shard") gives the files.
    """
    first, second = "_shuffle_1", "_shuffle_2"
    dealt = rows.withColumns({first: draw_hash(seed, keys, "shuffle"), second: draw_hash(seed, keys, "shuffle2")})
    placed = scan(dealt, [], [first, second, *keys], sums={"position": F.lit(1)}).drop(first, second).withColumn("position", F.col("position") - 1)
    total = placed.agg(F.count(F.lit(1))).first()[0]
    # in decimals, as position * shards may pass 64 bits
    return placed.withColumn("shard", F.expr(f"CAST(CAST(position AS DECIMAL(20,0)) * {int(shards)} DIV {max(total, 1)} AS INT)"))


def union_languages(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def top_n_accepted(rows: DataFrame, accepted: Column, n: int, seed, keys, group=()) -> DataFrame:
    """Exactly n accepted rows (all if fewer), in seeded order, per group or overall."""
    good = rows.filter(accepted).withColumn("_order", draw_hash(seed, keys, "accept"))
    if not group:
        return good.orderBy("_order", *keys).limit(n).drop("_order")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_order", *keys))
    return good.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_order", "_rn")


def sample_contexts(rows: DataFrame, stacks: DataFrame, seed, keys, request_type="action") -> DataFrame:
    """A random scenario per row: a device type, a device of it, and a service with arguments or an attribute.

    `stacks` holds real and synthetic devices together, numbered inside their type. Types that
    offer no service give no context.
    """
    kinds = fixed.DEVICE_DOMAINS
    typed = rows.withColumn("type", draw_choice(seed, keys, "type", kinds))
    got = pick_target_devices(typed, stacks, seed, keys)
    if request_type == "status":
        pick = F.lit("state")
        for t, names in fixed.CONTEXT_STATUS_ATTRIBUTES.items():
            pick = F.when(F.col("type") == t, draw_choice(seed, keys, "attribute", names)).otherwise(pick)
        return got.withColumn("attribute", pick)
    pick = F.lit(None).cast("string")
    for t, names in fixed.CONTEXT_SERVICES.items():
        pick = F.when(F.col("type") == t, draw_choice(seed, keys, "service", [f"{t}.{s}" for s in names])).otherwise(pick)
    got = got.withColumn("service_name", pick).filter(F.col("service_name").isNotNull())
    chance = lambda p: draw_fraction(seed, keys, p) < F.lit(0.3)
    light, heat = F.col("service_name") == "light.turn_on", F.col("service_name") == "climate.set_temperature"
    args = F.concat_ws(", ",
                       F.when(light & chance("arg:b"), F.concat(F.lit('"brightness_pct": '), draw_int(seed, keys, "arg:bv", 10, 100).cast("string"))),
                       F.when(light & chance("arg:c"), F.concat(F.lit('"color_name": "'), draw_choice(seed, keys, "arg:cv", fixed.CONTEXT_COLORS), F.lit('"'))),
                       F.when(heat, F.concat(F.lit('"temperature": '), draw_int(seed, keys, "arg:t", 18, 28).cast("string"))))
    return got.withColumn("service_data", F.concat(F.lit("{"), args, F.lit("}")))
