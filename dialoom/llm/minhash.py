"""Links between texts whose sets of word shingles have a Jaccard similarity of `ALIKE` or more, decided on the sets.

Each different shingle set is a node, named by the XXH64 of its sorted shingle hashes. A shingle's hash is mixed from the
XXH64 of its words, so every word is hashed once. Pairs that the caller holds likely (near fingerprints) are decided first. What they leave
apart comes from MinHash: `BANDS` keys a node, each of `ROWS` minima; two sets alike by 0.8 share no key with a probability of
(1 - 0.8^5)^40 = 1e-7. SimHash segments alone would need 550 rows a node for 1e-4.

In every bucket each member is compared with one hub, which differs from bucket to bucket, so a family of near copies
costs one comparison per member and bucket, and none where both hang together already. The nodes of buckets that the links found don't hold together then meet by an exact
prefix filter: of n shingles in a common order, rare ones first, one of the first n - ceil(0.8 n) + 1 is common to
both sets of every linked pair. Only pairs of different components are compared, with the bounds of size and place.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, mix, stage, tidy
from dialoom.llm.components import components

BANDS, ROWS, AT_ONCE = 40, 5, 1024
WORDS_MOST = 100_000  # words whose hashes a task remembers
ALIKE = (4, 5)  # as a fraction, for comparisons of whole numbers
_draws = np.random.Generator(np.random.PCG64(42)).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
XOR, TIMES = _draws[0], _draws[1] | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_MOST:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


_hashes = _WordHashes()


def shingles(text: bytes | None, words_per_shingle: int) -> np.ndarray:
    """Sorted different hashes of the shingles; a text shorter than a shingle is one, an empty one has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "<u8")
    k, n = min(words_per_shingle, len(words)), len(words)
    each = np.fromiter(map(_hashes.__getitem__, words), "<u8", n)
    whole = np.full(n - k + 1, k, "<u8")
    for j in range(k):
        whole = mix(whole ^ each[j:n - k + 1 + j], j)
    return np.unique(whole)


def node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 42) - 2**63


def keys(found: np.ndarray) -> list:
    """A key for each band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), AT_ONCE):
        np.minimum(least, ((found[i:i + AT_ONCE, None] ^ XOR) * TIMES).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), j) - 2**63 for j, x in enumerate(least.reshape(BANDS, ROWS))]


def sketched(text: Column, words_per_shingle: int) -> Column:
    """struct(node, keys)."""
    @F.arrow_udf("node bigint, keys array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingles(t, words_per_shingle) for t in byte_texts(batch)]
            yield pa.StructArray.from_arrays([pa.array([node(s) for s in sets], pa.int64()), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], ["node", "keys"])
        tidy()

    return run(text)


def shingle_set(text: Column, words_per_shingle: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(t, words_per_shingle).view(np.int64) for t in byte_texts(batch)], pa.list_(pa.int64()))
        tidy()

    return run(text)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").where(both * (sum(ALIKE)) >= (F.size("ha") + F.size("hb")) * ALIKE[0]).select("a", "b")


def _rooted(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """node, root for every node."""
    return nodes.join(components(linked, "a", "b"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _across(sets: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different roots, among them all that are alike."""
    rows = sets.join(rooted, "node").select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("s"))
    rare = Window.partitionBy("node").orderBy("df", "s")
    ranked = rows.join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s").withColumn("at", F.row_number().over(rare))
    prefix = stage(ranked.where(f"at <= n - (n * {ALIKE[0]} + {ALIKE[1] - 1}) div {ALIKE[1]} + 1 and df > 1").select("s", "node", "root", "n", "at"))
    counted = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("members"))
    main = counted.groupBy("s").agg(F.max_by("root", "members").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    other = prefix.join(main, "s").where("root <> main")
    bound = f"(1 + least(x.n - x.at, y.n - y.at)) * {sum(ALIKE)} >= (x.n + y.n) * {ALIKE[0]}"  # the first common shingle meets it
    met = other.alias("x").join(prefix.alias("y"), F.expr(f"x.s = y.s and x.root <> y.root and least(x.n, y.n) * {ALIKE[1]} >= greatest(x.n, y.n) * {ALIKE[0]} and {bound}"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose nodes have different roots."""
    a, b = (rooted.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where("ra <> rb").select("a", "b")


def links(nodes: DataFrame, texts, likely: DataFrame, words_per_shingle=5) -> DataFrame:
    """a, b: links that connect all alike nodes (node, keys; distinct). texts(nodes) gives node, text for some of them.

    `likely` (a, b; staged) are pairs that are decided first.
    """
    homes = nodes.select("node", F.explode("keys").alias("key"))
    hub = F.min(F.col("node").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key"))
    buckets = homes.groupBy("key").agg(hub.alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    members = stage(homes.join(buckets, "key"))
    met = stage(members.select("node").union(likely.select(F.explode(F.array("a", "b")))).distinct())
    sets = stage(texts(met).select("node", shingle_set(F.col("text"), words_per_shingle).alias("hashes")))
    near = stage(_alike(likely, sets))
    to_hubs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = stage(near.union(_alike(_apart(to_hubs, stage(_rooted(met, near))), sets)))

    rooted = stage(_rooted(met, near))
    placed = members.select("key", "node").join(rooted, "node")
    torn = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    apart = stage(placed.join(torn, "key").select("node", "root").distinct())
    return near.union(_alike(stage(_across(sets, apart)), sets))
