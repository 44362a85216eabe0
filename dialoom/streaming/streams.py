"""Streaming twins of the batch operators.

State is kept per key by Structured Streaming; the checkpoint and every sink live in shared storage.
Rows of one key are put in order inside a micro-batch, whose size the source options bound.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.stage import stage_dir
from dialoom.operators.completions import dead_letter_calls, explode_calls, extract_blocks, normalize_tool_calls

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode="append", folder: str | None = None) -> DataFrame:
    """Run a stream over all available input and return what it wrote, with the batch id of each row.

    With a `folder` in shared storage a later run goes on where the last one ended, and the result is that of all runs.
    """
    spark = stream.sparkSession
    folder = folder or stage_dir(spark)
    path, checkpoint = f"{folder}/rows", f"{folder}/checkpoint"

    def save(batch, batch_id):
        # a repeated batch overwrites its own folder, so retries leave no duplicates
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def latest_state_stream(changes: DataFrame, entity="entity_id", state="state", ts="ts", initial: DataFrame | None = None) -> DataFrame:
    """Latest state and update time per entity; run in update mode.

    `initial`, a stream over the table of an earlier run (entity, state, last_update), makes a new checkpoint go on from there: its rows count as
    changes at their last update, so the order in which the two sources are read doesn't matter, and the aggregate stays a native one.
    """
    if initial is not None:
        changes = changes.select(entity, state, ts).unionByName(initial.select(entity, state, F.col("last_update").alias(ts)))
    return changes.groupBy(entity).agg(F.max_by(state, ts).alias(state), F.max(ts).alias("last_update"))


def newest_version(table: DataFrame, entity="entity_id") -> DataFrame:
    """The last written version of every entity of an update-mode table."""
    cols = [c for c in table.columns if c not in (entity, "batch_id")]
    last = table.groupBy(entity).agg(F.max_by(F.struct(*cols), "batch_id").alias("v"))
    return last.select(entity, *[F.col(f"v.{c}").alias(c) for c in cols])


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Closed gap sessions per key; a row later than the delay is dropped (`session_stream_keeping_late` keeps it)."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_event")).select(key, F.col("w.start").alias("start"), "last_event", "n")


def session_stream_keeping_late(events: DataFrame, key: str, ts: str, gap_seconds: int, delay: str) -> DataFrame:
    """As `session_stream`, but no row vanishes: key, kind, start, last_event, n, row.

    Kind `session` is a closed gap session. Kind `late` is a row that came when the watermark had passed its time plus the gap, or
    that has no time; `row` holds all its columns as JSON, n is 1. So the rows of a finished key are the sum of n. Rows may come in any order
    inside the delay: a row between two open sessions joins them. A closed session is final; a row that isn't late but within
    the gap of a closed session begins another. The state of a key is its open sessions, three numbers each, and goes away with the
    last of them; rows are taken in Arrow batch by Arrow batch, so a key with very many rows needs no more memory than others.
    Needs the RocksDB state store.
    """
    import numpy as np
    from pyspark.sql.streaming import StatefulProcessor

    gap, untimed = gap_seconds * 1_000_000, -(1 << 63)

    def merged(starts, lasts, counts):
        """Sorted sessions out of stretches in any order."""
        order = np.argsort(starts, kind="stable")
        starts, lasts, counts = starts[order], lasts[order], counts[order]
        reach = np.maximum.accumulate(lasts)
        first = np.flatnonzero(np.append(True, starts[1:] - reach[:-1] >= gap))
        return starts[first], np.maximum.reduceat(lasts, first), np.add.reduceat(counts, first)

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getListState("open", "start bigint, last bigint, n bigint")

        def _held(self):
            rows = list(self.open.get())
            return np.array([[int(x) for x in r] for r in rows], np.int64).reshape(-1, 3).T

        def _save(self, held, new=False):
            for timer in [] if new else list(self.handle.listTimers()):  # a key without open sessions has none
                self.handle.deleteTimer(timer)
            if not held.shape[1]:
                self.open.clear()
                return
            self.open.put([tuple(int(x) for x in row) for row in held.T])
            # a timer goes off when the watermark is beyond it: one millisecond before the first session may close
            self.handle.registerTimer(-(-int(held[1].min() + gap) // 1000) - 1)

        def _frame(self, key, kind, starts, lasts, counts, rows=None):
            import pandas as pd
            n = len(starts)
            made = {"start": starts, "last_event": lasts, "n": counts}
            if (starts == untimed).any():
                for name in ("start", "last_event"):
                    made[name] = pd.array(made[name], dtype="Int64")
                    made[name][starts == untimed] = pd.NA
            return pd.DataFrame({"k": np.array([key[0]] * n, object), "kind": np.array([kind] * n, object), **made, "row": np.array([None] * n if rows is None else rows, object)})

        def handleInputRows(self, key, rows, timerValues):
            limit = timerValues.getCurrentWatermarkInMs() * 1000  # 0: no row has been seen yet
            held, changed = self._held(), False
            new = not held.shape[1]
            for batch in rows:
                at = batch["us"].to_numpy(np.int64)
                late = at == untimed
                if limit > 0:
                    late |= at <= limit - gap
                if late.any():
                    yield self._frame(key, "late", at[late], at[late], np.ones(int(late.sum()), np.int64), batch["row"][late].tolist())
                at = at[~late]
                if len(at):
                    held, changed = np.stack(merged(*np.concatenate([held, np.stack([at, at, np.ones(len(at), np.int64)])], axis=1))), True
            if changed:
                self._save(held, new)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            limit = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000
            held = self._held()
            over = held[1] + gap <= limit
            self._save(held[:, ~over])
            yield self._frame(key, "session", *held[:, over])

        def close(self):
            pass

    # without the time column itself Spark doesn't filter late rows; the query keeps its watermark
    timed = events.withWatermark(ts, delay).select(F.col(key).alias("k"), F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(untimed)).alias("us"),
                                                   F.to_json(F.struct(*events.columns)).alias("row"))
    out = timed.groupBy("k").transformWithStateInPandas(
        statefulProcessor=Sessions(), outputStructType=f"k {timed.schema['k'].dataType.simpleString()}, kind string, start bigint, last_event bigint, n bigint, row string",
        outputMode="append", timeMode="eventTime")
    return out.select(F.col("k").alias(key), "kind", F.timestamp_micros("start").alias("start"), F.timestamp_micros("last_event").alias("last_event"), "n", "row")


def throttle_state(refreshes: DataFrame, changes: DataFrame, key: str, ts: str) -> DataFrame:
    """What `throttle_refresh` knew when it stopped, from its own table and the changes it had seen: key, refresh_at, pending.

    A change behind the last refresh that has led to none waits for the end of the cooldown. Both sides are reduced to one row per key
    before they meet; a key without a refresh, a NULL key too, had no change with a time.
    """
    last = refreshes.groupBy(F.col(key).alias("k")).agg(F.max("refresh_at").alias("refresh_at"))
    seen = changes.groupBy(F.col(key).alias("k")).agg(F.max(ts).alias("seen"))
    both = last.withColumnRenamed("k", "own").join(seen, F.col("own").eqNullSafe(F.col("k")), "left")
    return both.select(F.col("own").alias(key), "refresh_at", F.coalesce(F.col("seen") > F.col("refresh_at"), F.lit(False)).alias("pending"))


def throttle_refresh(changes: DataFrame, key: str, ts: str, interval_seconds: int, delay="0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """At most one refresh per interval and key: `refresh_at`, `kind` leading or trailing.

    A change outside the cooldown refreshes at once; changes inside it share one refresh at its end.
    `initial` (key, refresh_at, pending; see `throttle_state`), a written table with one row per key, is the state a new checkpoint begins with: what was pending is
    refreshed at the end of its cooldown also if its key sees no further change. Spark reads it in the first micro-batch only.
    A change without a time is left out. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    step = interval_seconds * 1_000_000

    class Throttle(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "at bigint, pending boolean")

        def _frame(self, key, rows):
            import pandas as pd
            return pd.DataFrame({"k": pd.Series([key[0]] * len(rows), dtype="object"), "at": [r[0] for r in rows], "kind": pd.Series([r[1] for r in rows], dtype="object")}).astype({"at": "int64"})

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            times = sorted(pd.concat([r["us"] for r in rows]).tolist())
            state = self.last.get() if self.last.exists() else None
            at, pending = (state[0], state[1]) if state else (None, False)
            was, out = pending, []
            for t in times:
                if pending and t >= at + step:
                    at, pending = at + step, False
                    out.append((at, "trailing"))
                if at is not None and t <= at:
                    continue
                if at is None or t >= at + step:
                    at = t
                    out.append((at, "leading"))
                else:
                    pending = True
            for timer in list(self.handle.listTimers()) if was else []:
                self.handle.deleteTimer(timer)
            if pending:
                self.handle.registerTimer((at + step) // 1000)
            if at is not None:
                self.last.update((at, pending))
            yield self._frame(key, out)

        def handleInitialState(self, key, initialState, timerValues):
            at, pending = int(initialState["us"].iloc[0]), bool(initialState["pending"].iloc[0])
            self.last.update((at, pending))
            if pending:
                self.handle.registerTimer((at + step) // 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state = self.last.get()
            rows = []
            if state and state[1]:
                rows.append((state[0] + step, "trailing"))
                self.last.update((state[0] + step, False))
            yield self._frame(key, rows)

        def close(self):
            pass

    timed = changes.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("at_ts"), F.unix_micros(ts).alias("us")).withWatermark("at_ts", delay)
    start = None if initial is None else initial.select(F.col(key).alias("k"), F.unix_micros(F.col("refresh_at").cast("timestamp")).alias("us"), "pending").groupBy("k")
    out = timed.groupBy("k").transformWithStateInPandas(
        statefulProcessor=Throttle(), initialState=start, outputStructType=f"k {timed.schema['k'].dataType.simpleString()}, at bigint, kind string", outputMode="append", timeMode="eventTime")
    return out.select(F.col("k").alias(key), F.timestamp_micros("at").alias("refresh_at"), "kind")


def _runs(batches):
    """Of chunks (k, seq, content, is_last) those that follow one another as one row, with a list of contents; the others as lists of one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        if not batch.num_rows:
            continue
        key, seq, content, last = (batch.column(c) for c in ("k", "seq", "content", "is_last"))
        last = pc.fill_null(last, False)
        begins = np.ones(batch.num_rows, bool)
        if not pa.types.is_nested(key.type):  # such keys can't be compared here
            follows = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(seq[1:], pc.add(seq[:-1], 1)))
            begins[1:] = ~pc.fill_null(pc.and_(follows, pc.invert(last[:-1])), False).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(begins)
        ends = np.append(first[1:], batch.num_rows)
        contents = pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int32()), content)
        yield pa.RecordBatch.from_arrays([key.take(pa.array(first)), seq.take(pa.array(first)), contents, last.take(pa.array(ends - 1))], ["k", "seq", "contents", "is_last"])


def parse_completion_stream(chunks: DataFrame, key="conv_id", think=("<think>", "</think>"), tool=("<tool_call>", "</tool_call>"),
                            idle_seconds: int | None = None, gap_seconds: int | None = None, most_waiting=10_000) -> DataFrame:
    """Text and call rows out of completion chunks (key, seq from 0 without gaps, content, is_last).

    A chunk waits until all with a smaller seq are there, also over micro-batches. Thinking is hidden, but calls inside it
    count, as in the batch parser; call blocks are held back until they close, also when a marker is split over chunks.
    The last chunk flushes what is open: a call counts as closed, thinking without an end is text. Output rows are numbered
    per key by `out_seq`. Every chunk is read once (`Markers`); open blocks lie in the state in pieces. Chunks of a task that follow one
    another are moved as one row, and what a micro-batch brings for a key in one go is read in one go.

    A gap is given up when `most_waiting` chunks wait behind it, or when no chunk has come for `gap_seconds`, which gives a row of
    kind `gap` with the missing numbers; a chunk of a given-up gap that comes after all gives a row of kind `late`.
    A key without chunks for `idle_seconds` is flushed and forgotten. Both are processing times and need a query that goes on
    running: with timers Spark plans batches without end, so `availableNow` would never stop. A chunk that comes twice counts once.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    from dialoom.streaming.markers import PIECE, Markers

    open_fields = ["mode", "tail", "open_think", "open_tool", "n_think", "n_tool"]
    timed = idle_seconds is not None or gap_seconds is not None

    class Parser(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("open", "mode string, tail string, open_think string, open_tool string, n_think bigint, n_tool bigint, emitted bigint, next_seq bigint, last_at bigint, n_waiting bigint")
            self.waiting = handle.getMapState("waiting", "seq bigint", "content string, is_last boolean")
            self.pieces = handle.getMapState("pieces", "block string, number bigint", "content string")
            self.skipped = handle.getMapState("skipped", "first bigint", "last bigint")

        # the store of Markers
        def put(self, block, number, text):
            self.pieces.updateValue((block, number), (text,))

        def take(self, block, count):
            taken = []
            for n in range(count):
                taken.append(self.pieces.getValue((block, n))[0])
                self.pieces.removeKey((block, n))
            return taken

        def _load(self):
            known = self.state.get()
            if known:
                *held, self.emitted, self.seq, self.last_at, self.n_waiting = known
                self.markers = Markers(think, tool, **dict(zip(open_fields, held)))
            else:
                self.markers, self.emitted, self.seq, self.last_at, self.n_waiting = Markers(think, tool), 0, 0, 0, 0
            self.out, self.text, self.done = [], [], False
            self.fresh, self.n_fresh = [], 0  # chunks in order that the markers haven't seen yet
            self.known = bool(known)

        def _said(self, kind, content):
            if kind == "text":
                self.text.append(content)
                return
            if self.text:
                self.out.append(("text", "".join(self.text)))
                self.text = []
            self.out.append((kind, content))

        def _take_chunk(self, content, last):
            if content:
                self.fresh.append(content)
                self.n_fresh += len(content)
                if self.n_fresh > PIECE:
                    self._read()
            self.seq += 1
            self.done = last

        def _read(self):
            if self.fresh:
                self.markers.feed(self, "".join(self.fresh), self._said)
                self.fresh, self.n_fresh = [], 0

        def _take_waiting(self):
            while self.n_waiting and not self.done and self.waiting.containsKey((self.seq,)):
                content, last = self.waiting.getValue((self.seq,))
                self.waiting.removeKey((self.seq,))
                self.n_waiting -= 1
                self._take_chunk(content, last)

        def _give_up_gap(self):
            first = min(k[0] for k in self.waiting.keys())
            self._read()
            self.skipped.updateValue((self.seq,), (first - 1,))
            self._said("gap", f"{self.seq}-{first - 1}")
            self.known = True
            self.seq = first
            self._take_waiting()

        def _rows(self, key):
            self._read()
            if self.done:
                self.markers.finish(self, self._said)
            if self.text:
                self.out.append(("text", "".join(self.text)))
            return [Row(k=key[0], out_seq=self.emitted + i, kind=kind, content=content) for i, (kind, content) in enumerate(self.out)]

        def _save(self, now):
            for timer in list(self.handle.listTimers()) if timed else []:
                self.handle.deleteTimer(timer)
            if self.done:
                if self.n_waiting:
                    self.waiting.clear()
                for state in (self.state, self.skipped) if self.known else []:  # pieces are gone with the blocks
                    state.clear()
                return
            self.state.update((*(getattr(self.markers, f) for f in open_fields), self.emitted + len(self.out), self.seq, self.last_at, self.n_waiting))
            waits = [s for s, on in ((gap_seconds, self.n_waiting > 0), (idle_seconds, True)) if s is not None and on]
            if waits:
                self.handle.registerTimer(max(now + 1, self.last_at + min(waits) * 1000))

        def handleInputRows(self, key, rows, timerValues):
            came = sorted(((r.seq + i, content, r.is_last and i == len(r.contents) - 1) for r in rows for i, content in enumerate(r.contents)), key=lambda c: c[0])
            self._load()
            self.last_at = timerValues.getCurrentProcessingTimeInMs() if timed else 0
            for n, content, last in came:
                if self.done:
                    break
                if n == self.seq:
                    self._take_chunk(content, last)
                    self._take_waiting()
                elif n < self.seq:
                    gap = next(((a[0], b[0]) for a, b in self.skipped.iterator() if a[0] <= n <= b[0]), None)
                    if gap:  # the numbers around it stay missing
                        self._read()
                        self._said("late", content)
                        self.skipped.removeKey((gap[0],))
                        for a, b in ((gap[0], n - 1), (n + 1, gap[1])):
                            if a <= b:
                                self.skipped.updateValue((a,), (b,))
                elif not self.waiting.containsKey((n,)):
                    self.waiting.updateValue((n,), (content, last))
                    self.n_waiting += 1
                    if most_waiting is not None and self.n_waiting > most_waiting:
                        self._give_up_gap()
            result = self._rows(key)
            self._save(self.last_at)
            yield from result

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._load()
            now = timerValues.getCurrentProcessingTimeInMs()
            over = idle_seconds is not None and now >= self.last_at + idle_seconds * 1000
            while self.n_waiting and not self.done and (over or (gap_seconds is not None and now >= self.last_at + gap_seconds * 1000)):
                self._give_up_gap()
            self.done = self.done or over
            result = self._rows(key)
            self._save(now)
            yield from result

        def close(self):
            pass

    rows = chunks.select(F.col(key).alias("k"), F.col("seq").cast("bigint").alias("seq"), "content", "is_last")
    kind = rows.schema["k"].dataType.simpleString()
    runs = rows.mapInArrow(_runs, f"k {kind}, seq bigint, contents array<string>, is_last boolean")
    out = runs.groupBy("k").transformWithState(
        statefulProcessor=Parser(), outputStructType=f"k {kind}, out_seq bigint, kind string, content string",
        outputMode="append", timeMode="ProcessingTime" if timed else "none")
    return out.withColumnRenamed("k", key)


def stream_dead_letters(completions: DataFrame, keys, text="completion"):
    """Run call parsing over a stream into two tables: (good calls, messages standing in for bad ones).

    Each micro-batch is parsed once, into one table of calls; both results read that. A stream without rows gives empty tables.
    """
    spark = completions.sparkSession
    path = stage_dir(spark)
    parsed = lambda batch: normalize_tool_calls(explode_calls(extract_blocks(batch, text), *keys))

    def save(batch, batch_id):
        parsed(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    query = completions.writeStream.option("checkpointLocation", stage_dir(spark)).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    schema = parsed(spark.createDataFrame([], completions.schema)).schema
    parsed_none = spark.createDataFrame([], schema)
    parsed_none.write.parquet(f"{path}/batch_id=-1")
    good, bad = dead_letter_calls(spark.read.schema(schema).parquet(path), [*keys, "call_pos"])
    return good.select(*keys, "call_pos", "tool_name", "args"), bad


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that the per-key processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
