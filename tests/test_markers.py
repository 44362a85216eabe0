"""The marker automaton: any cut of a text gives the same, in linear time; gaps and idle keys in a stream."""
import random
import re
import time

import pyarrow as pa
import pytest

from dialoom.functions.stage import stage_dir
from dialoom.streaming import markers, streams

THINK, TOOL = ("<think>", "</think>"), ("<tool_call>", "</tool_call>")


def run(chunks):
    out, store, m = [], markers.MemoryStore(), markers.Markers(THINK, TOOL)
    for c in chunks:
        m.feed(store, c, lambda k, t: out.append((k, t)))
    m.finish(store, lambda k, t: out.append((k, t)))
    assert not store.pieces
    return "".join(t for k, t in out if k == "text"), [t for k, t in out if k == "call"]


def whole(text):
    """By searching the whole text."""
    block, body, calls = re.compile(re.escape(TOOL[0]) + "(.*?)" + re.escape(TOOL[1]), re.S), "", []
    while True:
        start = min((p for p in (text.find(THINK[0]), text.find(TOOL[0])) if p >= 0), default=-1)
        if start < 0:
            return body + text, calls
        thinking = text.startswith(THINK[0], start)
        body, text = body + text[:start], text[start + len(THINK[0] if thinking else TOOL[0]):]
        end = text.find(THINK[1] if thinking else TOOL[1])
        if end < 0 and not thinking:
            return body, [*calls, text]
        inner = text if end < 0 else text[:end]
        calls += block.findall(inner) if thinking else [inner]
        if end < 0:
            return body + THINK[0] + block.sub("", inner), calls
        text = text[end + len(THINK[1] if thinking else TOOL[1]):]


@pytest.mark.parametrize("piece", [1 << 14, 3])
def test_any_cut_gives_the_same(piece, monkeypatch):
    monkeypatch.setattr(markers, "PIECE", piece)
    r = random.Random(1)
    parts = [*THINK, *TOOL, "<", "</", "<think", "<tool_", "call>", "a", "text ", "\n", "é🙂"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 9)))
        assert run([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]) == whole(text)


def test_large_blocks_take_linear_time():
    def seconds(n):
        text = "<tool_call>" + "<tool" * (n // 5) + "</tool_call>ok"
        start = time.process_time()
        body, calls = run([text[i:i + 7] for i in range(0, len(text), 7)])
        assert body == "ok" and len(calls[0]) == n // 5 * 5
        return time.process_time() - start

    seconds(100_000)
    assert seconds(10_000_000) < 12 * max(seconds(1_000_000), 0.2)


def chunked(spark, *batches):
    schema, path = "conv_id int, seq int, content string, is_last boolean", stage_dir(spark)
    streams.use_rocksdb(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_gaps_are_given_up_and_late_chunks_kept(spark):
    stream = chunked(spark, [(1, 0, "a", False), (1, 0, "again", False)], [(1, 5, "f", False), (1, 6, "g", False), (1, 4, "e<tool", False)], [(1, 2, "c", False)], [(1, 7, "h", True)])
    got = sorted(streams.run_to_table(streams.parse_completion_stream(stream, most_waiting=2)).collect(), key=lambda r: r.out_seq)
    assert [(r.kind, r.content) for r in got if r.kind != "text"] == [("gap", "1-3"), ("late", "c")]
    assert "".join(r.content for r in got if r.kind == "text") == "ae<toolfgh"


def test_gaps_and_idle_keys_are_given_up_after_the_wait(spark):
    stream = chunked(spark, [(1, 0, "a", False), (1, 2, "c", False), (2, 0, "x<tool_call>y", False)])
    path = stage_dir(spark)
    parsed = streams.parse_completion_stream(stream, gap_seconds=1, idle_seconds=2)

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = parsed.writeStream.outputMode("append").option("checkpointLocation", stage_dir(spark)).trigger(processingTime="1 second").foreachBatch(save).start()
    try:
        until, got = time.time() + 90, []
        while time.time() < until and len(got) < 5 and query.isActive:
            time.sleep(3)
            if query.lastProgress:
                got = spark.read.schema(parsed.schema).parquet(path).collect()
    finally:
        query.stop()
    rows = [(r.conv_id, r.kind, r.content) for r in sorted(got, key=lambda r: (r.conv_id, r.out_seq))]
    assert rows == [(1, "text", "a"), (1, "gap", "1-1"), (1, "text", "c"), (2, "text", "x"), (2, "call", "y")]


def test_large_block_over_micro_batches(spark):
    block = "".join(random.Random(3).choice("ab<{\"") for _ in range(120_000))
    text = "say <tool_call>" + block + "</tool_call> done"
    rows = [(9, i // 7, text[i:i + 7], i + 7 >= len(text)) for i in range(0, len(text), 7)]
    stream = chunked(spark, rows[:6000], rows[6000:12000][::-1], rows[12000:])
    got = sorted(streams.run_to_table(streams.parse_completion_stream(stream)).collect(), key=lambda r: r.out_seq)
    assert [r.content for r in got if r.kind == "call"] == [block] and "".join(r.content for r in got if r.kind == "text") == "say  done"


def test_chunks_that_follow_one_another_are_moved_as_one_row():
    rows = [(1, 0, "a", False), (1, 1, None, False), (1, 2, "c", True), (1, 3, "d", None), (2, 4, "e", False), (2, 6, "f", False), (2, 6, "g", False), (None, 7, "h", False), (None, 8, "i", True)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "seq", "content", "is_last"), r)) for r in rows],
                                       pa.schema([("k", pa.int32()), ("seq", pa.int64()), ("content", pa.string()), ("is_last", pa.bool_())]))
    got = [tuple(r.values()) for b in streams._runs([batch.slice(0, 0), batch]) for r in b.to_pylist()]
    assert got == [(1, 0, ["a", None, "c"], True), (1, 3, ["d"], False), (2, 4, ["e"], False), (2, 6, ["f"], False), (2, 6, ["g"], False),
                   (None, 7, ["h"], False), (None, 8, ["i"], True)]


def test_a_late_chunk_stays_between_the_texts_around_it(spark):
    stream = chunked(spark, [(1, 0, "a", False), (1, 3, "d", False), (1, 4, "e", False)], [(1, 5, "f", False), (1, 2, "c", False), (1, 6, "<tool", False), (1, 7, "_call>x", True)])
    got = sorted(streams.run_to_table(streams.parse_completion_stream(stream, most_waiting=1)).collect(), key=lambda r: r.out_seq)
    assert [(r.kind, r.content) for r in got] == [("text", "a"), ("gap", "1-2"), ("text", "de"), ("late", "c"), ("text", "f"), ("call", "x")]
