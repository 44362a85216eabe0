"""Queries: streams over the given tables, and the batch session query."""
from pyspark.sql import functions as F

from dialoom.functions.stage import stage, stage_dir
from dialoom.operators.sessions import link_sessions
from dialoom.plans.inputs import TEXTS, spark_input, with_inputs
from dialoom.plans.scoring import BLOCKS, sql_normalize
from dialoom.streaming import streams as T

# completions without a keyed model, one key per message
TEXTS |= {"stream_texts": """
SELECT conv_id * 100 + turn AS msg_id, completion FROM {completions}"""}


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(1 << 30)).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream_of(*tables):
    """A stream that delivers the given tables one after the other, in micro-batches of bounded size."""
    spark, path = tables[0].sparkSession, stage_dir(tables[0].sparkSession)
    for t in tables:
        t.write.mode("append").parquet(path)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 8).parquet(path)


def t1_latest_state_stream(spark, sf_dir):
    changes = _events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), F.struct("event_id", "event_type").alias("state"), F.struct("ts", "event_id").alias("ts"))
    got = T.newest_version(T.run_to_table(T.latest_state_stream(changes), "update"))
    return got.select("entity_id", F.col("state.event_type").alias("state"), F.col("last_update.ts").cast("timestamp_ntz").alias("last_update"))


def t2_throttle_refresh(spark, sf_dir):
    T.use_rocksdb(spark)
    got = T.run_to_table(T.throttle_refresh(_events(spark, sf_dir), "user_id", "ts", 6 * 3600))
    return got.select("user_id", F.col("refresh_at").cast("timestamp_ntz").alias("refresh_at"), "kind")


def _halves(spark, sf_dir):
    """The events in two tables: the first half of the time they span, and the rest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.select(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("bigint"))).scalar()
    return events.where(F.col("ts") <= span), events.where(F.col("ts") > span)


def t1_latest_state_from_table(spark, sf_dir):
    """The first half of the events in one run; a new checkpoint takes that run's table for its start and sees the second half only."""
    changes = lambda df: _stream_of(df.select(F.col("user_id").alias("entity_id"), F.struct("event_id", "event_type").alias("state"), F.struct("ts", "event_id").alias("ts")))
    first, second = _halves(spark, sf_dir)
    table = T.newest_version(T.run_to_table(T.latest_state_stream(changes(first)), "update"))
    got = T.newest_version(T.run_to_table(T.latest_state_stream(changes(second), initial=_stream_of(table)), "update"))
    return got.select("entity_id", F.col("state.event_type").alias("state"), F.col("last_update.ts").cast("timestamp_ntz").alias("last_update"))


def t2_throttle_from_table(spark, sf_dir):
    """As t2_throttle_refresh, stopped after the first half of the events and taken up with a new checkpoint from what it had written."""
    T.use_rocksdb(spark)
    first, second = _halves(spark, sf_dir)
    one = T.run_to_table(T.throttle_refresh(_stream_of(first), "user_id", "ts", 6 * 3600))
    state = stage(T.throttle_state(one, first, "user_id", "ts"))
    two = T.run_to_table(T.throttle_refresh(_stream_of(second), "user_id", "ts", 6 * 3600, initial=state))
    return one.unionByName(two).select("user_id", F.col("refresh_at").cast("timestamp_ntz").alias("refresh_at"), "kind")


def t3_parse_completion_stream(spark, sf_dir):
    T.use_rocksdb(spark)
    # seven characters a chunk and an empty one at the end; each text is cut in one go
    pieces = F.regexp_extract_all("completion", F.lit("(?s).{1,7}"), F.lit(0))
    texts = spark_input(spark, sf_dir, "stream_texts").repartition("msg_id").select("msg_id", F.concat(pieces, F.array(F.lit(""))).alias("pieces"))
    chunks = stage(texts.select("msg_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "content")).select(
        "msg_id", "seq", "content", (F.col("seq") == F.col("n") - 1).alias("is_last")))
    got = T.run_to_table(T.parse_completion_stream(_stream_of(chunks.filter("seq < 9"), chunks.filter("seq >= 9 and seq < 40"), chunks.filter("seq >= 40")), "msg_id"))
    joined = lambda k, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("out_seq", "content")))), lambda x: x["content"]), sep)
    # a message has as many pieces as its text has chunks at most
    return got.groupBy("msg_id").agg(joined("text", "").alias("body"), joined("call", "\n").alias("calls"))


def t4_session_stream(spark, sf_dir):
    got = T.run_to_table(T.session_stream(_events(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n")


def t4_sessions_keeping_late(spark, sf_dir):
    """Every tenth event comes in a second run, most of them too late for their sessions."""
    T.use_rocksdb(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, folder = stage_dir(spark), stage_dir(spark)
    for part in (events.where("event_id % 10 <> 0"), events.where("event_id % 10 = 0")):
        part.write.mode("append").parquet(source)
        got = T.run_to_table(T.session_stream_keeping_late(spark.readStream.schema(events.schema).parquet(source), "user_id", "ts", 6 * 3600, "1 hour"), folder=folder)
    return got.select("user_id", "kind", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n",
                      F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"))


def t5_stream_dead_letters(spark, sf_dir):
    good, bad = T.stream_dead_letters(_stream_of(spark_input(spark, sf_dir, "stream_texts")), ["msg_id"])
    return good.select("msg_id", "call_pos", "tool_name", "args").unionByName(bad.select("msg_id", "call_pos", "part", "role", "content"), allowMissingColumns=True)


def w8_link_sessions(spark, sf_dir):
    rows = spark_input(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return link_sessions(rows, "user_id", "ts", 3 * 3600, "event_id")


QUERIES = {f.__name__: f for f in (w8_link_sessions, t1_latest_state_stream, t1_latest_state_from_table, t2_throttle_refresh, t2_throttle_from_table, t3_parse_completion_stream, t4_session_stream, t4_sessions_keeping_late, t5_stream_dead_letters)}

_OPEN = "completion || CASE WHEN contains(regexp_replace(completion, '<tool_call>(.*?)</tool_call>', '', 'gs'), '<tool_call>') THEN '</tool_call>' ELSE '' END"
_T5 = BLOCKS.replace("conv_id, turn", "msg_id").replace("CASE WHEN has_api THEN ", "").replace(" ELSE [] END AS raw_calls", " AS raw_calls").replace("FROM completions", "FROM stream_texts") \
    + "," + sql_normalize("calls", keep="msg_id, call_pos, raw_call")
def _numbered(rows):
    """`sid` numbers the stretches of a user's events that are less than six hours apart, in DuckDB."""
    apart = "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END"
    return f"SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (SELECT *, {apart} AS b FROM ({rows}))"


ORACLES = {
    "w8_link_sessions": """WITH l AS (SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER w < INTERVAL 3 HOURS, false) AS linked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT *, CAST(sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM l""",
    "t1_latest_state_stream": "SELECT user_id AS entity_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS last_update FROM events GROUP BY 1",
    "t2_throttle_refresh": """WITH RECURSIVE r(user_id, refresh_at, kind) AS (SELECT user_id, min(ts), 'leading' FROM events GROUP BY 1
      UNION ALL SELECT * FROM (SELECT r.user_id, greatest(n.t, r.refresh_at + INTERVAL 6 HOURS) AS refresh_at, CASE WHEN n.t >= r.refresh_at + INTERVAL 6 HOURS THEN 'leading' ELSE 'trailing' END
        FROM r, LATERAL (SELECT min(ts) AS t FROM events e WHERE e.user_id = r.user_id AND e.ts > r.refresh_at) n WHERE n.t IS NOT NULL) x)
      SELECT * FROM r WHERE refresh_at <= (SELECT max(ts) FROM events)""",
    "t3_parse_completion_stream": with_inputs("stream_texts") + f"""SELECT msg_id, regexp_replace(regexp_replace({_OPEN}, '<think>(.*?)</think>', '', 'gs'), '<tool_call>(.*?)</tool_call>', '', 'gs') AS body,
      array_to_string(regexp_extract_all({_OPEN}, '<tool_call>(.*?)</tool_call>', 1, 's'), chr(10)) AS calls FROM stream_texts""",
    "t4_session_stream": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events),
      s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l)
      SELECT user_id, min(ts) AS start, max(ts) AS last_event, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "t4_sessions_keeping_late": f"""WITH seen AS (SELECT max(ts) FILTER (WHERE event_id % 10 <> 0) - INTERVAL 1 HOUR AS w1, max(ts) - INTERVAL 1 HOUR AS w2 FROM events),
      e AS (SELECT event_id, user_id, ts, event_id % 10 = 0 AS second, event_id % 10 = 0 AND ts + INTERVAL 6 HOURS <= w1 AS late, w1, w2 FROM events, seen),
      first_run AS (SELECT *, max(ts) OVER (PARTITION BY user_id, sid) + INTERVAL 6 HOURS <= w1 AS closed FROM ({_numbered("SELECT * FROM e WHERE NOT second")})),
      still AS (SELECT user_id, ts, w2 FROM first_run WHERE NOT closed UNION ALL SELECT user_id, ts, w2 FROM e WHERE second AND NOT late)
      SELECT user_id, 'session' AS kind, min(ts) AS start, max(ts) AS last_event, count(*) AS n, NULL::BIGINT AS event_id FROM first_run WHERE closed GROUP BY user_id, sid
      UNION ALL SELECT user_id, 'session', min(ts), max(ts), count(*), NULL FROM ({_numbered("SELECT * FROM still")}) GROUP BY user_id, sid, w2 HAVING max(ts) + INTERVAL 6 HOURS <= w2
      UNION ALL SELECT user_id, 'late', ts, ts, 1, event_id FROM e WHERE late""",
    "t5_stream_dead_letters": with_inputs("stream_texts", tail=_T5) + """SELECT msg_id, call_pos, tool_name, args, NULL AS part, NULL AS role, NULL AS content FROM normalized WHERE error IS NULL
      UNION ALL SELECT msg_id, call_pos, NULL, NULL, part, CASE part WHEN 0 THEN 'assistant' ELSE 'tool_result' END,
        CASE part WHEN 0 THEN '[{"args":{},"name":"unknown"}]' ELSE '{"error":' || to_json('Error occurred calling tool with args=''' || raw_call || ''': ' || error)::VARCHAR || '}' END
      FROM normalized, (VALUES (0), (1)) v(part) WHERE error IS NOT NULL""",
}
# stopping and going on from the table changes no row
ORACLES |= {"t1_latest_state_from_table": ORACLES["t1_latest_state_stream"], "t2_throttle_from_table": ORACLES["t2_throttle_refresh"]}
