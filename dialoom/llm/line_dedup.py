"""Reversible line deduplication: exact reference counts with sharded cuckoo filters in front.

A `LineStore` keeps, per shard of the key space, an exact table (key digest -> number of documents that have
the line) and a cuckoo filter of the keys that are common, that is found in at least `min_docs` documents.
Inserting documents raises counts, deleting them lowers counts again; keys that cross the threshold enter
or leave their shard's filter. Cuckoo filters can delete, so the store after inserting and deleting the same
documents answers as before.

A line's key is the line without white space (space, tab to carriage return) at both ends and with A-Z in
lower case; digests are 128 bits (XXH3). Keys shorter than `min_chars` code points are never common.
Documents are screened against the filters, and what passes is looked up in the exact table, so a filter's
false positive never drops a line.

Null and empty texts are one empty line and stay as they are. Every row is a document: repeated rows count
as often as they stand there. Empty tables give an empty store and an empty result.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, fresh, stage, text_key, tidy, with_text

SPACE = b" \t\n\v\f\r"
SLOTS = 4  # per bucket


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # lower() of bytes changes A-Z only


def line_digests(text: bytes | None, min_chars: int) -> dict:
    """Digest of each different line that is long enough, in order."""
    keys = dict.fromkeys(map(line_key, (text or b"").split(b"\n")))
    return {k: xxhash.xxh3_128_digest(k) for k in keys if len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars}


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints, four to a bucket, over digests given as two unsigned 64-bit words."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table

    @staticmethod
    def for_keys(n: int) -> "Cuckoo":
        return Cuckoo(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    def _places(self, words: np.ndarray):
        """Fingerprint and both buckets of each key; the second is found from the first and the fingerprint alone."""
        mask = np.uint64(len(self.table) - 1)
        mark = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = words[:, 0] & mask
        return mark, first.astype(np.int64), (first ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark):
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)

    def has(self, words: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(words)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def add(self, words: np.ndarray) -> bool:
        """False if the filter is too full; its caller then builds a larger one from the exact table."""
        kick = np.random.default_rng(7)
        for mark, a, b in zip(*self._places(words)):
            at = a
            for _ in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if not len(free):
                    at = b if at == a else at
                    free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
                slot = kick.integers(SLOTS)
                mark, self.table[at, slot] = self.table[at, slot], mark
                at = int(np.uint64(at) ^ self._jump(np.asarray(mark)))
                a = b = at
            else:
                return False
        return True

    def remove(self, words: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        for mark, a, b in zip(*self._places(words)):
            for at in (a, b):
                where = np.flatnonzero(self.table[at] == mark)
                if len(where):
                    self.table[at, where[0]] = 0
                    break


def _words(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2) if len(keys) else np.zeros((0, 2), np.uint64)


def _updated_filter(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after `keys` (key, was, now: whether the key was and is common)."""
    shard = int(keys["shard"].iloc[0]) if len(keys) else int(old["shard"].iloc[0])
    common = _words(keys["key"][keys["now"]].tolist()) if len(keys) else _words([])
    cuckoo = Cuckoo(0, np.frombuffer(old["filter"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else None
    if cuckoo is not None and len(keys):
        cuckoo.remove(_words(keys["key"][keys["was"] & ~keys["now"]].tolist()))
        if len(common) > 0.9 * cuckoo.table.size or not cuckoo.add(_words(keys["key"][keys["now"] & ~keys["was"]].tolist())):
            cuckoo = None
    if cuckoo is None:
        cuckoo = Cuckoo.for_keys(len(common))
        while not cuckoo.add(common):
            cuckoo = Cuckoo(2 * len(cuckoo.table))
    return pd.DataFrame({"shard": [shard], "filter": [cuckoo.table.tobytes()]})


@dataclass
class LineStore:
    """counts: shard, key, n. filters: shard, filter. Both are staged tables; every change gives a new store."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @staticmethod
    def of(docs: DataFrame, min_docs=10, min_chars=1, docs_per_shard=20_000) -> "LineStore":
        """A store of all `docs`, with shards in proportion to their number."""
        return LineStore.empty(docs.sparkSession, min_docs, min_chars, max(16, docs.count() // docs_per_shard)).insert(docs)

    @staticmethod
    def empty(spark, min_docs=10, min_chars=1, shards=64) -> "LineStore":
        """`shards` bounds the work on one filter: with n different lines a shard holds about n / shards of them."""
        return LineStore(spark.createDataFrame([], "shard int, key binary, n bigint"), spark.createDataFrame([], "shard int, filter binary"), min_docs, min_chars, shards)

    def insert(self, docs: DataFrame) -> "LineStore":
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> "LineStore":
        """Take out documents that were inserted before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> "LineStore":
        min_chars, min_docs, shards = self.min_chars, self.min_docs, self.shards

        def keys(batches):
            for batch in batches:  # counted per batch before the shuffle, so a common line travels once per batch
                counts: dict = {}
                for text in byte_texts(batch.column(0)):
                    for digest in line_digests(text, min_chars).values():
                        counts[digest] = counts.get(digest, 0) + 1
                yield pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["key", "n"])
            tidy()

        change = docs.select("text").mapInArrow(keys, "key binary, n bigint").select(
            F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", (F.col("n") * sign).alias("n"), F.lit(0).cast("bigint").alias("before"))
        old = self.counts.select("shard", "key", "n", F.col("n").alias("before"))
        counts = stage(old.unionByName(change).groupBy("shard", "key").agg(F.sum("n").alias("n"), F.sum("before").alias("before")).where("n > 0 or before > 0"))
        crossed = counts.select("shard", "key", (F.col("before") >= min_docs).alias("was"), (F.col("n") >= min_docs).alias("now")).where("was or now")
        filters = stage(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_updated_filter, "shard int, filter binary"))
        return LineStore(counts.where("n > 0").select("shard", "key", "n"), filters, min_docs, min_chars, shards)

    def common(self) -> DataFrame:
        """The keys whose lines are dropped."""
        return self.counts.where(F.col("n") >= self.min_docs).select("key")

    def screen(self, text: Column, broadcast_bytes=64 << 20) -> Column:
        """Digests of the lines that may be common. Filters go to the executors only if their summed size is at most
        `broadcast_bytes`; beyond it every digest is looked up in the exact table. The result is the same."""
        spark, min_chars, shards = self.filters.sparkSession, self.min_chars, self.shards
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        held = {r["shard"]: bytes(r["filter"]) for r in self.filters.toLocalIterator()} if size <= broadcast_bytes else None
        shared = spark.sparkContext.broadcast(held)

        @F.arrow_udf("array<binary>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            filters = None if shared.value is None else {s: Cuckoo(0, np.frombuffer(f, np.uint16).reshape(-1, SLOTS)) for s, f in shared.value.items()}
            for batch in batches:
                found = [list(line_digests(t, min_chars).values()) for t in byte_texts(batch)]
                if filters is not None:
                    flat = [d for ds in found for d in ds]
                    shard = np.array([(xxhash.xxh64_intdigest(d, seed=42) + (1 << 63)) % (1 << 64) - (1 << 63) for d in flat], np.int64) % shards  # Spark's xxhash64, pmod
                    words, hit = _words(flat), np.zeros(len(flat), bool)
                    for s in filters:
                        at = np.flatnonzero(shard == s)
                        hit[at] = filters[s].has(words[at])
                    hits = iter(hit)
                    found = [[d for d in ds if next(hits)] for ds in found]
                yield pa.array(found, pa.list_(pa.binary()))
            tidy()

        return run(text)

    def mark(self, docs: DataFrame, name: str) -> DataFrame:
        """`docs` plus `name`: digests of its common lines (null if none)."""
        key = fresh(docs, "line_doc")
        keyed = docs.withColumn(key, text_key("doc_id", "text"))
        hits = keyed.select(F.col(key).alias("line_doc"), F.explode(self.screen(F.col("text"))).alias("key"))
        found = hits.join(self.common(), "key").groupBy("line_doc").agg(F.collect_set("key").alias("keys"))
        return keyed.join(found.select(F.col("line_doc").alias(key), F.col("keys").alias(name)), key, "left").drop(key)


def without_lines(text: Column, drop: Column) -> Column:
    """struct(text, n_lines, n_dropped): the text without the lines whose digest is in `drop`, and the line counts."""
    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, drop in batches:
            yield cleaned(texts, drop)
        tidy()

    def cleaned(texts: pa.Array, drop: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for text, gone in zip(byte_texts(texts), drop.to_pylist()):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if gone:
                gone = set(gone)
                lines = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            out.append(text if text is None or not n_dropped[-1] else b"\n".join(lines))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                          names=["text", "n_lines", "n_dropped"])

    return run(text, drop)


def drop_common_lines(docs: DataFrame, store: LineStore) -> DataFrame:
    """`docs` with the common lines taken out of each text; all columns and rows stay."""
    gone, done = fresh(docs, "line_gone"), fresh(docs, "line_done")
    cleaned = store.mark(docs, gone).withColumn(done, without_lines(F.col("text"), F.col(gone)))
    return with_text(cleaned, F.col(done)["text"]).select(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    store = LineStore.of(docs, min_docs=10, min_chars=1)
    done = store.mark(docs, "gone").select("doc_id", without_lines(F.col("text"), F.col("gone")).alias("r"))
    return done.select("doc_id", "r.n_lines", "r.n_dropped", F.sha2(F.coalesce("r.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
