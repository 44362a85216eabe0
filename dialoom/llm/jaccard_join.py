"""Size-aware heavy-light join of shingle sets at a Jaccard similarity of 0.85 or more, exact.

A document's set holds its different shingles (64-bit hashes mixed from the XXH64 of their words). Documents with equal sets share a node, so copies take part once.
Two sets of x and y shingles link if they have `need(x, y)` in common. With all shingles in one order, any two linked sets have
their first common shingles near their beginnings; which order it is doesn't matter, and rare shingles come first here.

- Small sets (light) enumerate subsets of a fixed size: all pairs of the shingles at their beginning. Linked small
  sets share the pair of their two first common shingles.
- Large sets (heavy) scan inverted lists: every shingle at the beginning of a set has a list of the sets that begin with it.
  Small sets that are large enough to link with a large one stand in these lists too.
- The boundary is chosen by cost: pairs are enumerated as long as they are fewer than the rows of inverted lists
  plus the entries met in them, with the mean length of the lists counted over the whole corpus.

The order is by frequency class and hash. Frequent shingles (a passage in a third of all documents) are counted over all
documents; those in more than a threshold of sets come last, and at most 2^20 of them are sent around. The lists of the rest are short.

Candidates: each list (or pair of shingles) names its smallest node as hub, and each node is compared with the likeliest of the two hubs
of most of its lists, so a family of near copies costs two bitmaps and one comparison a member instead of all pairs. Nodes which that leaves apart meet wherever a list holds
several groups, with bounds of size and place, so no link between groups is lost; long lists are compared block by block inside tasks, in
rounds: first a few partners a node, at last all between the groups that remain. Bitmaps (parities of shingle hashes)
bound the overlap of a pair from above; the rest is decided on the shingles of both texts. Components join what is linked.

Null, empty and blank texts have no shingle and are linked with nothing. Fewer words than a shingle: one shingle of them all. Two
different sets of up to five shingles can't link. Repeated rows: equal rows of the result. A null doc_id is no smallest one unless
there is no other. Very long texts: one set is held at a time. Empty table: no rows. Nodes are 64-bit hashes of whole
sets: n different sets share one by accident with a probability of n^2 / 2^65.
"""
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, mix, stage, text_key, tidy
from dialoom.llm.components import components
from dialoom.llm.minhash import node, shingles

WORDS = 4
SHARE = (17, 37)  # need(x, y) = ceil((x + y) * 17 / 37), as 100 i >= 85 (x + y - i)
LEAST = 6  # smaller sets link with equal ones only
FREQUENT, HOT_MOST = 32, 1 << 20
PAIRS_MOST = 1000  # the boundary stays below, so that a set has at most some ten thousand pairs
BITS_PER_SHINGLE, BITMAP_MOST = 4, 1 << 16
SEEN = 100_000  # sets a task remembers, so as not to write copies again
CROWDED, BLOCK = 64, 1024  # nodes of a list
TRIES = (2, 16, None)  # partners that a node of a crowded list names, round by round; None: all
KEY = (1 << 48) - 1


def begin(n, common: int, larger: bool):
    """How many shingles at a set's beginning hold `common` of those shared with a partner that is smaller or, if not `larger`, with one at least as large."""
    least = (17 * n + 19) // 20 if larger else (34 * n + 36) // 37
    return n - least + common


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of hashes in a power of two of bits."""
    bits = 64
    while bits < min(BITS_PER_SHINGLE * len(found), BITMAP_MOST):
        bits *= 2
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class Order:
    """Frequent shingles last, by class of frequency; else by hash."""

    def __init__(self, shingle: np.ndarray, times: np.ndarray):
        at = np.argsort(shingle)
        self.shingle, self.level = shingle[at], np.log2(times[at]).astype(np.int8)

    def arranged(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        """The set in order, and how many of it aren't frequent."""
        if not len(self.shingle) or not len(found):
            return found, len(found)
        at = np.minimum(np.searchsorted(self.shingle, found), len(self.shingle) - 1)
        hit = self.shingle[at] == found
        hot = found[hit]
        return np.concatenate([found[~hit], hot[np.lexsort((hot, self.level[at[hit]]))]]), int(len(found) - hit.sum())


def pairs_of(beginning: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of shingles and the place (from 1) of the later one."""
    i, j = np.triu_indices(len(beginning), 1)
    return mix(beginning[i], 1) ^ mix(beginning[j], 2), j + 1


class _Once:
    """The last SEEN sets of a task."""

    def __init__(self):
        self.seen = OrderedDict()

    def new(self, name: int) -> bool:
        if name in self.seen:
            self.seen.move_to_end(name)
            return False
        self.seen[name] = True
        if len(self.seen) > SEEN:
            self.seen.popitem(last=False)
        return True


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def beginnings(text: Column) -> Column:
    """The lowest hashes of a set: a quarter more than its beginning, so that frequent ones can make way."""
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        once = _Once()
        for batch in batches:
            out = []
            for t in byte_texts(batch):
                found = shingles(t, WORDS)
                n = len(found)
                out.append(_signed(found[:begin(n, 1, True) * 5 // 4 + 4]) if n >= LEAST and once.new(node(found)) else None)
            yield pa.array(out, pa.list_(pa.int64()))
        tidy()

    return run(text)


def entries(text: Column, shared, boundary: int) -> Column:
    """struct(node, n, lists, cold, pairs, bits): the set's node and size, its keys (of the first copy in a task) and bitmap."""
    kind = [("node", pa.int64()), ("n", pa.int32()), ("lists", pa.list_(pa.int64())), ("cold", pa.int32()), ("pairs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))]
    in_lists = (17 * (boundary + 1) + 19) // 20  # the smallest partner of a set beyond the boundary

    @F.arrow_udf("struct<node: bigint, n: int, lists: array<bigint>, cold: int, pairs: array<bigint>, places: array<int>, bits: array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        once, order = _Once(), shared.value
        for batch in batches:
            rows = []
            for t in byte_texts(batch):
                found = shingles(t, WORDS)
                n, name = len(found), node(found) if len(found) else None
                if n < LEAST or not once.new(name):
                    rows.append((name, n, None, 0, None, None, None))
                    continue
                arranged, cold = order.arranged(found)
                lists = _signed(arranged[:begin(n, 1, True)]) if n >= in_lists else None
                keys, places = pairs_of(arranged[:begin(n, 2, True)]) if n <= boundary else (None, None)
                rows.append((name, n, lists, cold, None if keys is None else _signed(keys & np.uint64(KEY)), None if keys is None else places.astype(np.int32), bitmap(found)))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 7, kind)], names=[k for k, _ in kind])
        tidy()

    return run(text)


def _frequent(docs: DataFrame) -> tuple[Order, float]:
    """The frequent shingles, and how many entries an inverted list holds on average where it is met."""
    seen = Observation()
    low = docs.select(F.explode(beginnings(F.col("text"))).alias("s"))
    counted = low.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    counted = counted.observe(seen, F.sum("df").alias("rows"), F.sum(F.when(F.col("df") <= FREQUENT, F.col("df") * F.col("df"))).alias("met"))
    often = stage(counted.where(F.col("df") > FREQUENT))
    levels = often.agg(*[F.count_if(F.col("df") > FREQUENT * 2**k).alias(f"l{k}") for k in range(40)]).first()
    k = next(k for k in range(40) if levels[k] <= HOT_MOST)
    hot = often.where(F.col("df") > FREQUENT * 2**k).toArrow()  # at most HOT_MOST rows
    order = Order(hot["s"].to_numpy().view(np.uint64), hot["df"].to_numpy())
    return order, (seen.get["met"] or 0) / max(1, seen.get["rows"] or 0)


def boundary(mean_list: float) -> int:
    """The largest size up to which pairs of shingles are fewer than list rows and the entries met in lists."""
    n = np.arange(1, PAIRS_MOST + 1)
    p = begin(n, 2, True)
    cheap = p * (p - 1) / 2 <= begin(n, 1, True) * (1 + mean_list)
    return int(n[cheap].max()) if cheap.any() else 0


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: each (key, node) once, and only where its key has several nodes."""
    held, joined = None, False  # the last row, and whether the one before it has its key
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        key, name = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        first = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
        batch, key = batch.filter(pa.array(first)), key[first]
        like_next = key[1:] == key[:-1]
        keep = np.append(joined, like_next[:-1])[:len(like_next)] | like_next
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep))
        joined = bool(like_next[-1]) if len(like_next) else joined
        held = batch.slice(batch.num_rows - 1)
    if held is not None and joined:
        yield held


def _lists(sets: DataFrame) -> DataFrame:
    """key, node, n, at (place of the shingle, or of the later one of a pair), two (pairs): all entries of lists with several nodes."""
    single = sets.select("node", "n", "cold", F.posexplode("lists").alias("at", "key")).select(F.col("key").bitwiseAND(F.lit(KEY)).alias("key"), "node", "n", (F.col("at") + 1).alias("at"), F.lit(False).alias("two"), (F.col("at") >= F.col("cold")).alias("hot"))
    two = sets.select("node", "n", F.explode(F.arrays_zip("pairs", "places")).alias("x")).select("x.pairs", "node", "n", "x.places", F.lit(True), F.lit(False))
    rows = single.union(two)
    columns = ["key", "node", "n", "at", "two"]
    # Lists of frequent shingles have several nodes for sure; they are not gathered by key.
    frequent = rows.where("hot").select(*columns).dropDuplicates(["key", "node"])
    rest = rows.where("not hot").select(*columns).repartition("key").sortWithinPartitions("key", "node")
    return stage(rest.mapInArrow(_shared_only, "key bigint, node bigint, n int, at int, two boolean").union(frequent))


def _possible(x: str, y: str) -> str:
    """Bounds of size and place for entries x and y of a list: the shared shingle is the first (of a pair: second) common one."""
    before = f"(if({x}.two, 2, 1) + least({x}.n - {x}.at, {y}.n - {y}.at))"
    near = f"least({x}.n, {y}.n) * 20 >= greatest({x}.n, {y}.n) * 17"
    return f"{x}.node <> {y}.node and {near} and {before} * {SHARE[1]} >= ({x}.n + {y}.n) * {SHARE[0]}"


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that their bitmaps allow, with `apart`, a lower bound of the shingles that only one of both has."""
    bits = sets.where("bits is not null").select("node", "n", "bits").dropDuplicates(["node"])
    a, b = (bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")) for x in "ab")

    def folded(x, y):
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("xa", "xb"), folded("xb", "xa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    near = pairs.join(a, "a").join(b, "b").withColumn("apart", apart)
    return near.where(f"(na + nb - apart) * {SHARE[1]} >= 2 * (na + nb) * {SHARE[0]}").select("a", "b", "apart")


def _alike(a: Column, b: Column) -> Column:
    """Whether two texts' sets link."""
    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, found = None, None
        for x, y in batches:
            out = []
            for s, t in zip(byte_texts(x), byte_texts(y)):
                if s != last:
                    last, found = s, shingles(s, WORDS)
                other = shingles(t, WORDS)
                out.append(len(np.intersect1d(found, other, assume_unique=True)) * SHARE[1] >= (len(found) + len(other)) * SHARE[0])
            yield pa.array(out, pa.bool_())
        tidy()

    return run(a, b)


def _decided(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their texts."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = sets.where("bits is not null").select("node", "row").join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    texts = stage(docs.select(text_key("doc_id", "text").alias("row"), "text").join(one, "row").dropDuplicates(["node"]).select("node", "text"))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.where(_alike(F.col("ta"), F.col("tb"))).select("a", "b")


def _ordered_pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _to_hubs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """For each node the likeliest of the hubs it may link with: of the two that most of its lists name, the one with the nearer bitmap.

    The members of a family share lists with many hubs; whom the one chosen here doesn't link is met in `links`.
    """
    hubs = stage(lists.groupBy("key").agg(F.min("node").alias("hub")))
    hub = lists.alias("h").join(hubs, "key").where("node = hub").select("key", "node", "n", "at", "two")
    met = lists.alias("x").join(stage(hub).alias("h"), "key").where(_possible("x", "h")).groupBy(F.col("x.node").alias("a"), F.col("h.node").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("lists", "b")), asc=False), 1, 2)
    near = _bounded(met.groupBy("a").agg(first.alias("x")).select("a", F.explode("x.b").alias("b")), sets)
    best = near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x"))
    return best.select("a", F.col("x.b").alias("b"))


def _torn(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists that hold several groups, with each entry's root, the list's main group and its size."""
    met = lists.select("node").distinct()
    rows = stage(lists.join(_rooted(met, found), "node"))
    counted = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    main = counted.groupBy("key").agg(F.max_by("root", "members").alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("members").alias("total")).where("roots > 1").select("key", "main", "total")
    return rows.join(stage(main), "key")


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a node, and the root of the group that the links found so far put it in."""
    return rows.join(stage(components(found, "a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _met(few: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that meet in a list within all bounds; for lists with few nodes."""
    met = few.where("root <> main").alias("x").join(few.alias("y"), F.expr(f"x.key = y.key and x.root <> y.root and {_possible('x', 'y')}"))
    return _bounded(met.select(*_ordered_pair("x.node", "y.node")).distinct(), sets).select("a", "b")


def _crowded(crowd: DataFrame, sets: DataFrame, most: int | None) -> DataFrame:
    """a, b, key, more: as `_met` for crowded lists, but a node names `most` partners in two blocks, and `more` says that others are left (None: all).

    The lists are cut into blocks, and a task compares the bitmaps of two blocks, so that of a crowd only pairs that may link leave it.
    """
    known = sets.where("bits is not null").select("node", *(["lists"] if most is None else []), "bits").dropDuplicates(["node"])
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    placed = crowd.join(known, "node").withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = placed.select("key", *[f("own", "other").alias(n) for f, n in ((F.least, "i"), (F.greatest, "j"))], "own", "node", "n", "at", "two", "root", *known.columns[1:])

    def run(group: pa.Table) -> pa.Table:
        return _meet_in_blocks(group, most)

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint, key bigint, more boolean")


def _first_tries(near: np.ndarray, most: int) -> np.ndarray:
    """Of a matrix of candidates `most` of each row and of each column, with the partners that have most candidates: a crowd names the same few. All, if they are no more than that."""
    if near.sum() <= most * sum(near.shape):
        return near
    kept = np.zeros_like(near)
    for side, out in ((near, kept), (near.T, kept.T)):
        order = np.argsort(-side.sum(axis=0), kind="stable")
        asked = side[:, order]
        out[:, order] |= asked & (np.cumsum(asked, axis=1, dtype=np.int32) <= most)
    return kept


def _meet_in_blocks(group: pa.Table, most: int | None) -> pa.Table:
    """Pairs of one list within the bounds of size, place and bitmaps: `most` of each node, or all whose first common shingle is that of the list."""
    group = group.combine_chunks()
    name, n, at, root, own = (group.column(c).to_numpy() for c in ("node", "n", "at", "root", "own"))
    both = 2 if group.column("two")[0].as_py() else 1
    words = np.array([len(x) for x in group.column("bits")])
    if most is None:
        earlier = [[] if both == 2 or x is None else x[:p - 1] for x, p in zip(group.column("lists").to_pylist(), at.tolist())]
    found, more = [], False
    for w in np.unique(words):
        for v in (w, 2 * w):  # sets that can link have bitmaps of the same size or of twice that
            x, y = np.flatnonzero(words == w), np.flatnonzero(words == v)
            if not len(y):
                continue
            left, right = (np.array([group.column("bits")[int(k)].as_py() for k in z], np.int64).reshape(len(z), -1) for z in (x, y))
            right = right if v == w else right[:, :w] ^ right[:, w:]
            apart = np.zeros((len(x), len(y)), np.int32)
            for k in range(w):
                apart += np.bitwise_count((left[:, k, None] ^ right[None, :, k]).view(np.uint64))
            a, b = n[x][:, None].astype(np.int64), n[y][None, :].astype(np.int64)
            size = a + b
            near = (size - apart) * SHARE[1] >= 2 * size * SHARE[0]
            near &= (both + np.minimum(a - at[x][:, None], b - at[y][None, :])) * SHARE[1] >= size * SHARE[0]
            near &= (np.minimum(a, b) * 20 >= np.maximum(a, b) * 17) & (root[x][:, None] != root[y][None, :])
            if (group.column("i")[0] != group.column("j")[0]):
                near &= own[x][:, None] != own[y][None, :]
            if most is not None:
                tries = _first_tries(near, most)
                more |= bool((near & ~tries).any())
                near = tries
            if v == w:
                near = (near | near.T) & (name[x][:, None] < name[y][None, :])
            i, j = np.nonzero(near)
            if len(i) and both == 1 and most is None:
                column = {s: c for c, s in enumerate({s for k in (*x, *y) for s in earlier[k]})}
                has = []
                for z in (x, y):
                    m = np.zeros((len(z), len(column)), np.float32)
                    for r, k in enumerate(z):
                        m[r, [column[s] for s in earlier[k]]] = 1
                    has.append(m)
                first = ~((has[0] @ has[1].T) > 0)[i, j]
                i, j = i[first], j[first]
            found.append((name[x][i], name[y][j]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    key = np.full(len(a), group.column("key")[0].as_py(), np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "key": pa.array(key), "more": pa.array(np.full(len(a), more))})


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links that connect all nodes that link; `sets` is staged.

    In a crowded list nodes try a few partners first; what that links is one group, so that of a family of near copies not all pairs have to be
    decided. Lists in which candidates were left are met again by the groups of then, in the last of TRIES for all pairs between different groups.
    """
    lists = _lists(sets)
    found = stage(_decided(stage(_to_hubs(lists, sets)), sets, docs))
    torn = stage(_torn(lists, found))
    asked, tried = _met(torn.where(F.col("total") <= CROWDED), sets), None
    crowd = torn.where(F.col("total") > CROWDED)
    for most in TRIES:
        met = stage(_crowded(crowd, sets, most))
        pairs = met.select("a", "b").distinct()
        pairs = stage(asked.union(pairs).distinct() if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        found = found.union(stage(_decided(pairs, sets, docs))) if pairs.limit(1).count() else found
        left = met.where("more").select("key").distinct()
        if most is None or not left.limit(1).count():
            return found
        crowd = stage(_rooted(crowd.drop("root").join(left, "key"), found))
    return found


def jaccard_join(docs: DataFrame, doc_id="doc_id", text="text", pairs_up_to: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and node, the set's name.

    `pairs_up_to` overrides the boundary between small and large sets; the result doesn't depend on it.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order, mean_list = _frequent(docs)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    made = docs.select("doc_id", text_key("doc_id", "text").alias("row"), entries(F.col("text"), shared, boundary(mean_list) if pairs_up_to is None else pairs_up_to).alias("x"))
    sets = stage(made.select("doc_id", "row", "x.*"))

    roots = components(stage(links(sets, docs)), "a", "b")
    placed = sets.select("doc_id", "node", F.col("n").cast("bigint").alias("n_shingles"))
    first = placed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(least, "root").select("node", "component_id")
    return placed.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def op13(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).drop("node")
