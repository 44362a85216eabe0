"""Best-fit decreasing packing of token sequences into windows.

A document (its ids and an end id) that is longer than the window is first cut into full windows; what is left over
is one piece. Best-fit decreasing looks at pieces from long to short and puts each into the open window with the
least room that still holds it, which a segment tree indexed by remaining room finds. Pieces of one length are
interchangeable, so the plan needs only how many pieces there are of each length (at most `window` numbers,
whatever the corpus size). It gives runs: `so many pieces of this length go to these windows`. The pieces then
find their places by their rank within their length, on the executors.

Null or empty text: the end id alone. The string of an added token of the file, such as its end mark, becomes that token's id
wherever it stands, as the tokenizers library does by itself. Rows with the same doc_id are separate documents; rows equal in all fields
are interchangeable. Empty table: no pieces. Full windows have no padding at all.
"""
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import crc, stage, tidy

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class RoomTree:
    """Segment tree over rooms 0..window that says which is the least occupied one from a given room up."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, room: int, occupied: bool) -> None:
        i = room + self.size
        self.any[i] = occupied
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, room: int) -> int | None:
        i = room + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until there is something to the right
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # went over the right edge
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


@dataclass
class Plan:
    """Runs: pieces `rank`.. of `length` go to windows `first`.., `each` to a window, the first at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    windows: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.rank, self.length))
        key = (self.length[order].astype(np.int64) << 48) | self.rank[order]
        run = order[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
        inside = rank - self.rank[run]
        return self.first[run] + inside // self.each[run], self.offset[run] + (inside % self.each[run]) * length


def plan(counts: dict, window: int) -> Plan:
    """counts: length -> number of pieces. The number of runs depends on the window only, not on the counts."""
    tree, rooms, runs, windows = RoomTree(window), {}, [], 0

    def put(room, first, n):
        if n:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:  # open as many windows as the rest of this length needs
                each = window // length
                n = -(-left // each)
                put(window, windows, n)
                windows += n
                continue
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                tree.set(room, False)
            each = room // length  # best fit keeps filling the window it has just put a piece into
            full = min(n, left // each)
            offset = window - room
            if full:
                runs.append((length, done, first, each, offset))
                put(room - each * length, first, full)
                done, left = done + full * each, left - full * each
            if full < n:
                if 0 < left < each:
                    runs.append((length, done, first + full, each, offset))
                    put(room - left * length, first + full, 1)
                    put(room, first + full + 1, n - full - 1)
                    done, left = done + left, 0
                else:
                    put(room, first + full, n - full)
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, windows)


def byte_ranks(path: str) -> dict:
    """Token bytes -> id from a tokenizer JSON file. Its strings write each byte as one printable character: printable
    Latin-1 bytes as themselves, the others as U+0100 and up, in order."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The file's byte-level BPE with its added tokens. It gives the ids of the tokenizers library in a third of the time."""
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    ranks = {t: i for t, i in byte_ranks(path).items() if i not in added.values()}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encoded(encoding: tiktoken.Encoding, text: str | None) -> list:
    """Ids of a text; the strings of added tokens in it become their ids."""
    return encoding.encode(text or "", allowed_special="all")


def pieces(docs: DataFrame, path: str, pattern: str, window: int, end_id: int, with_ids=False) -> DataFrame:
    """All columns of `docs` and, one row per piece, `piece`: start, length, ids_crc32, doc_tokens and maybe ids."""
    fields = PIECE.replace(" ", ": ").replace(",:", ",") + (", ids: array<int>" if with_ids else "")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            out = []
            for text in batch:
                ids = np.array(encoded(encoding, text.as_py()) + [end_id], dtype="<u4")
                parts = [(s, ids[s:s + window]) for s in range(0, len(ids), window)]
                out.append([{"start": s, "length": len(p), "ids_crc32": crc(p.tobytes()), "doc_tokens": len(ids)} | ({"ids": p.astype(np.int32)} if with_ids else {}) for s, p in parts])
            kind = [pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")] + ([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])
            yield pa.array(out, pa.list_(pa.struct(kind)))
        tidy()

    return docs.withColumn("piece", F.explode(cut(F.col("text"))))


def pack(found: DataFrame, window: int, order: list, length="length", rows_per_chunk=20_000) -> DataFrame:
    """`found` (one row per piece) plus sequence_id and offset. `found` is read twice, so hand in a staged table.

    Ranks within a length are counted in chunks of a hash of `order`, so that a length shared by a third of all pieces
    is numbered by many tasks; only one small row per length and chunk meets the others of its length.
    """
    sizes = {r[0]: r[1] for r in found.groupBy(length).count().collect()}  # at most `window` rows
    laid = plan(sizes, window)
    chunks = max(16, sum(sizes.values()) // rows_per_chunk)
    chunked = found.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(length).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(length, "_chunk").count().select(length, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = (chunked.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_chunk").orderBy(*order)) - 1)
              .join(offsets, [length, "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_before")))
    shared = found.sparkSession.sparkContext.broadcast(laid)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(n: pa.Array, rank: pa.Array) -> pa.Array:
        at = shared.value.place(n.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in at], names=["sequence_id", "offset"])

    placed = ranked.withColumn("_at", place(F.col(length).cast("bigint"), F.col("_rank").cast("bigint")))
    return placed.select(*found.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, window=2048, end_id=1, with_ids=False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    found = stage(pieces(docs.select("doc_id", "text"), path, pattern, window, end_id, with_ids).select("doc_id", "piece.*"))
    return pack(found, window, ["doc_id", "start", "ids_crc32", "doc_tokens"])


def op3(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return pack_documents(docs, path, pattern, window=2048, end_id=1)
