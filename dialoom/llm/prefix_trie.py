"""Prefix trie of conversations that are rebuilt from shared heads, by composable fingerprints.

A conversation c is rebuilt as the first h turns of its base (c - c % 100) and its own turns after the first h, with h drawn
from c. The rebuilt texts are never made. Every turn has a hash; a sequence of turns has the fingerprint
H(t0, t1, ...) = t0 + t1 * B + t2 * B^2 + ... modulo the prime 2^31 - 1, for four bases B. Together with its length it is an
element of a monoid: (m, G) * (n, H) = (m + n, G + B^m * H). Prefixes of the original conversations are running sums, own
suffixes are differences of these, and the prefix of a rebuilt conversation is base head times own suffix, in numbers.

Prefixes with equal depth and fingerprint form a node. The grouping is checked: all members must agree in the parent's
fingerprint and in the stored turn (conversation, place) their last turn refers to, where equal turns refer to the first
of them, and turns that refer to another one are compared with it as text. By induction over depth equal groups are then equal
sequences. Should a check fail, everything is done again with other hashes.

Sums over subtrees need no walk: the value of a node is put on the path of its smallest member, running sums along
the paths (from deep to shallow) give each path's share below a prefix, and members add up their shares.

Long conversations: running sums go over ranges of rows (`scan`), no conversation is held by one task. The digest of a
node's ends is one SHA-256 over all ids in order, which is sequential by definition: ids are joined into pieces of up to 4096
by many tasks, and only the pieces of one node are read one after the other, without holding them.

Null conv_id: such turns belong to no conversation and are left out. Null turn comes first; rows of one conversation with equal turn are
ordered by role and text, repeated rows are turns of their own. Null role or text is empty. Empty table: no nodes. Extra columns are ignored.
"""
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.scan import scan
from dialoom.llm.common import stage

PRIME = 2**31 - 1
PARTS = 4  # components of a fingerprint, each below 2^31
HEAD, FAMILY = 6, 100
PIECE = 4096
ATTEMPTS = 4


def bases(seed: int) -> list:
    """Multipliers of the components."""
    return [int(x) for x in np.random.default_rng(1000 + seed).integers(2**20, PRIME - 1, PARTS)]


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo PRIME, for all exponents together."""
    out, square, left = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(PRIME), out)
        square, left = square * square % np.uint64(PRIME), left >> np.uint64(1)
    return out


def terms(turn: list[Column], place: Column, seed: int) -> Column:
    """array: each component of a turn's hash times its base to the power of `place`."""
    multipliers = bases(seed)

    @F.arrow_udf("array<bigint>")
    def run(at: pa.Array, *parts: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        done = [p.to_numpy(zero_copy_only=False).astype(np.uint64) * powers(b, at) % np.uint64(PRIME) for p, b in zip(parts, multipliers)]
        flat = np.stack(done, axis=1).astype(np.int64).ravel()
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, PARTS, dtype=np.int32), flat)

    return run(place, *turn)


def turn_hash(role: Column, text: Column, seed: int) -> list[Column]:
    """PARTS numbers below 2^31."""
    words = [F.xxhash64(F.lit(2 * seed + i), role, text) for i in range(PARTS // 2)]
    return [x for w in words for x in (F.shiftrightunsigned(w, 33), w.bitwiseAND(F.lit(PRIME)))]


def crc_of_decimal(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def _original(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns of the conversations as they are: conv, i (from 0), role, text, their hash x and the fingerprint sums s up to and with them."""
    given = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    placed = scan(given.where("conv is not null"), ["conv"], ordered, sums={"i": F.lit(1)}).withColumn("i", F.col("i") - 1)
    valued = placed.withColumn("x", F.array(*turn_hash(F.col("role"), F.col("text"), seed)))
    valued = valued.withColumn("t", terms([F.col("x")[k] for k in range(PARTS)], F.col("i"), seed)).drop("turn")
    summed = scan(valued, ["conv"], ["i"], sums={f"s{k}": F.col("t")[k] for k in range(PARTS)})
    return summed.withColumn("s", F.array(*[F.col(f"s{k}") % PRIME for k in range(PARTS)])).drop(*[f"s{k}" for k in range(PARTS)])


def _referred(turns: DataFrame) -> tuple[DataFrame, int]:
    """`turns` with `ref`, the first stored turn with the same hash; and how many turns differ from the one they refer to."""
    same = ["x"]
    first = turns.groupBy(*same).agg(F.min(F.struct("conv", "i")).alias("ref"), F.count(F.lit(1)).alias("times"))
    repeated = first.where("times > 1").select(*same, "ref")
    marked = turns.join(repeated, same, "left").withColumn("ref", F.coalesce("ref", F.struct("conv", "i")))
    marked = stage(marked)
    copies = marked.where("ref.conv <> conv or ref.i <> i").select("ref", "role", "text")
    source = marked.where("ref.conv = conv and ref.i = i").select("ref", F.col("role").alias("role0"), F.col("text").alias("text0"))
    return marked, copies.join(source, "ref").where("role <> role0 or text <> text0").count()


def _times(x: Column, y: Column) -> Column:
    return x * y % PRIME


def _rebuilt(turns: DataFrame, seed: int, head: int = HEAD, family: int = FAMILY) -> DataFrame:
    """One row per rebuilt turn and one of depth 0 per conversation: conv, depth, f (fingerprint), p (parent's), ref, chars, last (the deepest)."""
    by_conv = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("i") < head, F.struct("i", "s", "t", "ref", F.length("text").alias("chars"))))).alias("top"))
    by_conv = by_conv.withColumn("h", crc_of_decimal(F.col("conv")) % head)
    zero = F.array(*[F.lit(0).cast("bigint")] * PARTS)
    own = by_conv.select("conv", "n", "h", F.when(F.col("h") > 0, F.try_element_at("top", F.col("h").cast("int"))["s"]).alias("own_s"), (F.col("conv") - F.col("conv") % family).alias("base"))
    plan = own.join(by_conv.select(F.col("conv").alias("base"), F.col("top")), "base", "left").withColumn("top", F.coalesce(F.slice("top", F.lit(1), F.col("h").cast("int")), F.array()))
    plan = plan.withColumn("k", F.size("top").cast("bigint")).withColumn("head_s", F.when(F.col("k") > 0, F.try_element_at("top", F.size("top"))["s"]).otherwise(zero))
    plan = stage(plan.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    minus = lambda a, b: F.pmod(a - b, F.lit(PRIME))
    root = plan.select("conv", F.lit(0).cast("bigint").alias("depth"), zero.alias("f"), zero.alias("p"), F.struct(F.lit(0).cast("bigint").alias("conv"), F.lit(-1).cast("bigint").alias("i")).alias("ref"),
                       F.lit(0).cast("bigint").alias("chars"), (F.col("length") == 0).alias("last"))
    heads = plan.select("conv", "length", F.posexplode("top").alias("at", "x"))
    heads = heads.select("conv", (F.col("at") + 1).cast("bigint").alias("depth"), F.col("x.s").alias("f"), F.array(*[minus(F.col("x.s")[c], F.col("x.t")[c]) for c in range(PARTS)]).alias("p"),
                         "x.ref", F.col("x.chars").cast("bigint").alias("chars"), (F.col("at") + 1 == F.col("length")).alias("last"))
    # An own turn i moves to place i - h + k; k < h where the base is short, so terms are divided by B^(h - k).
    back = F.array(*[F.array(*[F.lit(pow(b, -j, PRIME)) for j in range(head)]) for b in bases(seed)])
    moved = turns.join(plan.where("n > h").select("conv", "h", "k", "own_s", "head_s", "length"), "conv").where("i >= h")
    shift = (F.col("h") - F.col("k")).cast("int")
    term = lambda c: _times(F.col("t")[c], back[c][shift])
    before = lambda c: F.when(F.col("h") > 0, F.col("own_s")[c]).otherwise(F.lit(0))
    at = lambda c: (F.col("head_s")[c] + _times(minus(F.col("s")[c], before(c)), back[c][shift])) % PRIME
    depth = F.col("i") - F.col("h") + F.col("k") + 1
    tails = moved.select("conv", depth.alias("depth"), F.array(*[at(c) for c in range(PARTS)]).alias("f"), F.array(*[minus(at(c), term(c)) for c in range(PARTS)]).alias("p"),
                         "ref", F.length("text").cast("bigint").alias("chars"), (depth == F.col("length")).alias("last"))
    packed = lambda x, i: F.shiftleft(F.col(x)[2 * i], 31) + F.col(x)[2 * i + 1]
    return root.union(heads).union(tails).select("conv", "depth", packed("f", 0).alias("f1"), packed("f", 1).alias("f2"), packed("p", 0).alias("p1"), packed("p", 1).alias("p2"), "ref", "chars", "last")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces, which come in order."""
    key, digest = None, None
    found = []

    def rows():
        cols = list(zip(*found)) or [()] * 4
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["depth", "f1", "f2", "ends"])

    for batch in batches:
        for depth, f1, f2, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "f1", "f2", "text"))):
            if key != (depth, f1, f2):
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = (depth, f1, f2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield rows()
    if key is not None:
        found.append((*key, digest.hexdigest()))
        yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends: SHA-256 of the comma-joined ids (conv) of each node's conversations, in numerical order."""
    key = ["depth", "f1", "f2"]
    ids = F.transform(F.sort_array(F.collect_set("conv")), lambda c: c.cast("string"))  # ids are distinct, so a piece holds PIECE of them at most
    pieces = ends.groupBy(*key, F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("text"))
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "text")
    return dealt.mapInArrow(_digests, "depth bigint, f1 bigint, f2 bigint, ends string")


def _attempt(conversations: DataFrame, seed: int) -> DataFrame | None:
    """The nodes, or None if hashes of this seed put different sequences together."""
    turns, differing = _referred(_original(conversations, seed))
    if differing:
        return None
    rows = stage(_rebuilt(turns, seed))
    key = ["depth", "f1", "f2"]
    grouped = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        (F.min("p1").eqNullSafe(F.max("p1")) & F.min("p2").eqNullSafe(F.max("p2")) & (F.min("ref.conv") == F.max("ref.conv")) & (F.min("ref.i") == F.max("ref.i"))).alias("sound"))
    nodes = stage(grouped)
    if nodes.where("not sound").limit(1).count():
        return None

    # The root's fingerprint is zero like its parent's, so depth keeps it apart.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    worth = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    paths = rows.select("conv", *key).join(worth, ["conv", "depth"], "left")
    below = scan(paths, ["conv"], [F.desc("depth")], sums={"saved": F.col("saved"), "leaf": F.col("leaf")})
    sums = below.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = ends_digests(rows.where("last").select(*key, "conv"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    rest = nodes.where("depth > 0").join(parents, ["depth", "p1", "p2"]).select(*top.columns)
    whole = top.union(rest).join(sums, key).join(ends, key, "left")
    return whole.withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the fingerprint f1, f2."""
    for seed in range(ATTEMPTS):
        nodes = _attempt(conversations, seed)
        if nodes is not None:
            return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "f1", "f2")
    raise RuntimeError(f"different turns had equal hashes {ATTEMPTS} times")


def op11(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations).drop("f1", "f2")
