"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each bit that is set in over half of the XXH64 values (seed 42) of the text's word
shingles. Fingerprints at most `distance` bits apart are linked, and the linked form groups.

The 64 bits are cut into segments; two linked fingerprints differ by at most `distance // segments` bits in one
of them. So each segment has a table of its values, each fingerprint looks up the small Hamming ball around its
own value in every table, and complete distances decide. Only distinct fingerprints take part: copies share one.
A bucket with many distinct fingerprints (a family of near copies) isn't joined row by row: its members are cut
into blocks, each pair of blocks is compared in one task with bounded memory, and only the links needed to hold
its members together are returned. No link between different fingerprints is lost in the groups.

Words are runs of anything but space and tab to carriage return, with A-Z in lower case. Null and empty texts have
fingerprint zero and are linked like any other. Texts shorter than a shingle are one shingle. Empty table: no rows.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import minhash
from dialoom.llm.common import byte_texts, fresh, mix, stage, text_key, tidy
from dialoom.llm.components import components

AT_ONCE = 100_000  # shingles whose bits are counted together


def simhash(text: bytes | None, words_per_shingle: int, size=1) -> list:
    """`size` fingerprints of 64 bits: the first of the hashes themselves, each further one of the hashes mixed anew."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * size
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words_per_shingle, len(words))
    a, b = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, h = np.zeros((size, 64), np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(a), AT_ONCE):
        values = np.array([h(joined[s:e], 42) for s, e in zip(a[i:i + AT_ONCE], b[i:i + AT_ONCE])], dtype="<u8")
        for j in range(size):
            bits = values if j == 0 else mix(values, j)
            ones[j] += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(a), axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: Column, words_per_shingle: int, size=1) -> Column:
    """The fingerprint bits as `size` bigints."""
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(t, words_per_shingle, size) for t in byte_texts(batch)], pa.list_(pa.int64()))
        tidy()

    return run(text)


def _ball(width: int, radius: int) -> list:
    """Masks of up to `radius` set bits."""
    masks, last = {0}, {0}
    for _ in range(radius):
        last = {m | 1 << b for m in last for b in range(width)} - masks
        masks |= last
    return sorted(masks)


def _stars(adjacent: np.ndarray) -> list:
    """(member, first member of its component), for members that aren't the first."""
    left, out = np.ones(len(adjacent), bool), []
    for i in range(len(adjacent)):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(adjacent[front].any(axis=0) & left)
                left[front] = False
                out += [(int(x), i) for x in front]
    return out


def _in_blocks(members: DataFrame, block: int, held_together) -> DataFrame:
    """a, b from held_together() on every pair of blocks of every bucket (s, key); a task holds two blocks."""
    blocks = members.groupBy("s", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.join(blocks, ["s", "key"]).select(*members.columns, own.alias("own"), other.alias("other"))
    paired = paired.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return paired.groupBy("s", "key", "i", "j").applyInPandas(held_together, "a bigint, b bigint")


def links(prints: DataFrame, distance=4, segments: int | None = None, bucket=64, block=1024) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct) at most `distance` bits apart.

    `segments` defaults to 3 up to 2^24 fingerprints and 2 beyond, so that unrelated values seldom share a bucket.
    """
    if segments is None:
        segments = 3 if prints.count() <= 1 << 24 else 2
    edges = [round(i * 64 / segments) for i in range(segments + 1)]

    def keyed(radius):
        """s, key, home, fp for every segment and every mask of its ball; shift, low and mask are literals."""
        masks = [F.struct(F.lit(i).alias("s"), F.lit(edges[i]).alias("shift"), F.lit((1 << edges[i + 1] - edges[i]) - 1).cast("bigint").alias("low"), F.lit(m).cast("bigint").alias("mask"))
                 for i in range(segments) for m in _ball(edges[i + 1] - edges[i], radius)]
        every = prints.select("fp", F.explode(F.array(*masks)).alias("x"))
        return every.select("x.s", F.expr("shiftrightunsigned(fp, x.shift) & x.low ^ x.mask").alias("key"), (F.col("x.mask") == 0).alias("home"), "fp")

    table, probes = keyed(0), keyed(distance // segments)
    sizes = stage(table.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket))

    small = table.join(sizes, ["s", "key"], "left_anti")
    apart = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    near = (probes.alias("p").join(small.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.key") == F.col("t.key")) & (F.col("p.fp") != F.col("t.fp")) & (apart <= distance))
            .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")))

    members = stage(probes.join(sizes.select("s", "key"), ["s", "key"]))

    def held_together(group: pd.DataFrame) -> pd.DataFrame:
        fp, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        adjacent = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        adjacent &= home[:, None] | home[None, :]
        pairs = np.array(_stars(adjacent), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[pairs[:, 0]].view(np.int64), "b": fp[pairs[:, 1]].view(np.int64)})

    return near.union(_in_blocks(members, block, held_together))


def groups(prints: DataFrame, linked: DataFrame, fp="fp", doc_id="doc_id") -> DataFrame:
    """fp, component_id for each distinct fingerprint of `prints` (a staged table): the smallest doc_id reachable over `linked`."""
    distinct = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first"))
    roots = components(linked, "a", "b")
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id", "root")


def near_prints(prints: DataFrame, distance=4) -> DataFrame:
    """a, b: pairs of nodes (columns node, bits) that connect all whose fingerprints are at most `distance` bits apart.

    The smallest node of a fingerprint stands for it, and the others of that fingerprint are paired with it.
    """
    nodes = stage(prints.groupBy("node").agg(F.min("bits").alias("bits")))
    first = stage(nodes.groupBy("bits").agg(F.min("node").alias("first")))
    same = nodes.join(first, "bits").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = links(first.select(F.col("bits").alias("fp")), distance).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x, y: first.select(F.col("bits").alias(x), F.col("first").alias(y))
    return same.union(linked.join(of("a", "na"), "a").join(of("b", "nb"), "b").select("na", "nb"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle=5) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (of equal doc_ids the one with the smallest text key).

    Documents are linked if their sets of different shingles have a Jaccard similarity of 0.8 or more. Fingerprints at most
    4 bits apart name the pairs that are decided first; alike sets with fingerprints further apart meet in `minhash.links`.
    """
    row, times = fresh(docs, "near_row"), fresh(docs, "near_times")
    keyed = docs.withColumn(row, text_key("doc_id", "text"))
    sketched = keyed.select("doc_id", F.col(row).alias("row"), minhash.sketched(F.col("text"), words_per_shingle).alias("x"), fingerprint(F.col("text"), words_per_shingle)[0].alias("bits"))
    prints = stage(sketched.select("doc_id", "row", F.col("x.node").alias("node"), F.col("x.keys").alias("keys"), "bits"))

    def texts(nodes: DataFrame) -> DataFrame:
        one = prints.select("node", "row").join(nodes, "node").groupBy("node").agg(F.min("row").alias("row"))
        return one.join(keyed.select(F.col(row).alias("row"), "text"), "row").dropDuplicates(["node"]).select("node", "text")

    likely = stage(near_prints(prints))
    linked = stage(minhash.links(prints.select("node", "keys").dropDuplicates(["node"]), texts, likely, words_per_shingle))
    kept = (prints.select("doc_id", "row", F.col("node").alias("fp")).join(groups(prints, linked, "node").select("fp", "root"), "fp").groupBy("root")
            .agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row")))
    counted = prints.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    kept = stage(kept.join(counted, "row").select(F.col("row").alias(row), F.col("times").alias(times)))
    stay = keyed.join(kept, row)
    single = stay.where(F.col(times) == 1)
    repeated = stay.where(F.col(times) > 1).dropDuplicates([row])  # equal rows of the table itself
    return single.union(repeated).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    prints = stage(docs.select("doc_id", fingerprint(F.col("text"), 4)[0].alias("fp")))
    found = groups(prints, links(prints.select("fp").distinct(), distance=4))
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
