"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, with DataFrame functions only.

A text is cut at line ends and after sentences that end in a, e or o (half the paragraphs, and cells, that cutting after
every sentence would give), and each different paragraph gets a 64-bit digest. A sketch has three thirds of `third` cells; a digest goes to one cell of each
third, and a cell holds the number of its digests, their XOR and the XOR of their check values. Subtracting two
sketches cell by cell leaves those of the differing digests; a cell with a single digest is recognised by its check,
yields it, and the digest is taken out of its other cells, until all cells are empty. If that stops early, the sketch
was too small: the pair is sketched again in blocks (by digest) whose number follows the number of paragraphs and
doubles with each retry, until every block can be peeled.

The fingerprint is the sketch of the whole text, written out, so equal texts have equal fingerprints. The likeness of
two texts is the share of common paragraphs among all of both (Jaccard), as recovered from the subtraction; two texts
without a paragraph are alike (1). Null text is empty. Repeated doc_ids stand next to each other, ordered by a
hash of their text; null ids come last. A table of one document is followed by itself.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import stage

PARAGRAPH = r"\n+|(?<=[aeo][.!?]) "
CHECK = "xxhash64({k}, 99)"


def paragraphs(text: Column) -> Column:
    """Digests of the different paragraphs."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _cell(key: str, j: int, third: int) -> str:
    return f"cast({j * third} + pmod(xxhash64({key}, {j}), {third}) as int)"


def sketch(keys: str, third: int) -> Column:
    """array<struct<c, k, x>> of 3 * third cells from the array column `keys`."""
    placed = f"transform({keys}, q -> named_struct('k', q, 'x', {CHECK.format(k='q')}, 'at', array({', '.join(_cell('q', j, third) for j in range(3))})))"
    zero = "named_struct('c', 0, 'k', 0L, 'x', 0L)"
    return F.expr(f"""element_at(transform(array({placed}), ps -> transform(sequence(0, {3 * third - 1}), i ->
        aggregate(ps, {zero}, (a, p) -> if(p.at[i div {third}] = i, named_struct('c', a.c + 1, 'k', a.k ^ p.k, 'x', a.x ^ p.x), a)))), 1)""")


def difference(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'x', p.x ^ q.x))")


def peel(cells: str, third: int) -> Column:
    """struct(ok, added, gone) of a difference: digests of the first sketch only, and of the second only."""
    pure = f"get(filter(s.cells, e -> abs(e.c) = 1 and e.x = {CHECK.format(k='e.k')}), 0)"
    hit = f"named_struct('c', p.c, 'k', p.k, 'x', p.x, 'at', array({', '.join(_cell('p.k', j, third) for j in range(3))}))"
    less = f"transform(s.cells, (e, i) -> if(i = h.at[0] or i = h.at[1] or i = h.at[2], named_struct('c', e.c - h.c, 'k', e.k ^ h.k, 'x', e.x ^ h.x), e))"
    step = f"""element_at(transform(array({pure}), p -> if(p is null, named_struct('cells', s.cells, 'added', s.added, 'gone', s.gone, 'go', false),
        element_at(transform(array({hit}), h -> named_struct('cells', {less}, 'added', s.added + if(h.c = 1, 1, 0), 'gone', s.gone + if(h.c = 1, 0, 1), 'go', true)), 1))), 1)"""
    return F.expr(f"""aggregate(sequence(1, {3 * third}), named_struct('cells', {cells}, 'added', 0, 'gone', 0, 'go', true), (s, n) -> if(s.go, {step}, s),
        s -> named_struct('ok', forall(s.cells, e -> e.c = 0 and e.k = 0L and e.x = 0L), 'added', s.added, 'gone', s.gone))""")


def written(cells: str) -> Column:
    """A sketch as text: per cell count, digests and check in hexadecimal."""
    return F.expr(f"lower(concat_ws('.', transform({cells}, e -> concat(hex(e.c), '-', hex(e.k), '-', hex(e.x)))))")


def likeness(peeled: Column, n_a: Column, n_b: Column) -> Column:
    apart = peeled["added"] + peeled["gone"]
    union = (n_a + n_b - apart) / 2 + apart
    return F.when(peeled["ok"], F.when(union == 0, 1.0).otherwise((n_a + n_b - apart) / 2 / union))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending doc_id; the first one's after the last.

    Ids are cut into about sqrt(range) chunks; the first document of each chunk is also sent, as a guest, to the chunk
    before it, so every chunk is ordered by itself and no text meets all others.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, int((high - low + 1) ** 0.5 / 2)) if low is not None else 1
    chunk = F.coalesce(F.floor(F.col("doc_id") / width).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    base = base.withColumns({"chunk": chunk, "h": F.xxhash64("text")})
    firsts = base.groupBy("chunk").agg(F.max(F.struct(F.col("doc_id"), F.col("h"))).alias("first"))
    over = Window.orderBy(F.desc("chunk"))  # one small row per chunk
    edges = firsts.select(F.lag("chunk").over(over).alias("to"), F.last("chunk").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"), "first")
    edges = stage(edges.select(F.coalesce("to", "lowest").alias("to"), F.col("first.doc_id").alias("edge_id"), F.col("first.h").alias("edge_h")))
    guests = (base.join(edges, F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("h") == F.col("edge_h")))
              .groupBy("to", "doc_id", "h").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("to").alias("chunk"), "h", F.lit(True).alias("guest")))
    rows = base.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("keys", paragraphs(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_keys": F.lead("keys").over(order)}).where("not guest").drop("chunk", "h", "guest")


def likenesses(pairs: DataFrame, third: int, per_block=3) -> DataFrame:
    """row, pair, near for pairs (row, pair, a, b: arrays of digests), by sketches in blocks, larger on every retry."""
    todo = stage(pairs.withColumn("blocks", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), (F.size("a") + F.size("b")) / per_block)))).cast("bigint")))
    done = None
    while todo.limit(1).count():
        keys = F.explode(F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(True).alias("first"))), F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(False).alias("first")))))
        dealt = todo.repartition("row").select("row", "pair", "blocks", keys.alias("x")).select("row", "pair", F.expr("pmod(xxhash64(x.k, 7), blocks)").alias("block"), "x")
        blocks = dealt.groupBy("row", "pair", "block").agg(F.expr("collect_list(x.k) filter (where x.first)").alias("a"), F.expr("collect_list(x.k) filter (where not x.first)").alias("b"))
        peeled = blocks.withColumns({"sa": sketch("a", third), "sb": sketch("b", third)}).withColumn("d", difference("sa", "sb")).select("row", "pair", peel("d", third).alias("p"))
        whole = peeled.groupBy("row", "pair").agg(F.struct(F.min("p.ok").alias("ok"), F.sum("p.added").alias("added"), F.sum("p.gone").alias("gone")).alias("p"))
        result = stage(whole.select("row", "pair", "p"))
        found = todo.join(result, ["row", "pair"]).select("row", "pair", likeness(F.col("p"), F.size("a"), F.size("b")).alias("near"))
        found = found.where(F.col("near").isNotNull())
        done = found if done is None else done.union(found)
        todo = stage(todo.join(result.where("not p.ok").select("row", "pair"), ["row", "pair"]).withColumn("blocks", F.col("blocks") * 2))
    return done if done is not None else todo.select("row", "pair", F.lit(0.0).alias("near"))


def op2(docs: DataFrame, third=6) -> DataFrame:
    k = F.expr("cast(floor(n_chars / 3) as int)")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 3) as int))"), F.substring("next_text", F.lit(1), k)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", paragraphs(F.col("edited")).alias("edited_keys"), "next_keys")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    made = rows.withColumns({"s": sketch("keys", third), "e": sketch("edited_keys", third), "n": sketch("next_keys", third)})
    made = made.withColumns({"de": difference("s", "e"), "dn": difference("s", "n")})
    first = stage(made.select("row", "doc_id", "n_chars", "edited_sha256", written("s").alias("fingerprint"), written("e").alias("edited_fingerprint"),
                              likeness(peel("de", third), F.size("keys"), F.size("edited_keys")).alias("edited"), likeness(peel("dn", third), F.size("keys"), F.size("next_keys")).alias("next")))
    again = rows.join(first.select("row", "edited", "next").where("edited is null or next is null"), "row")
    pairs = again.where("edited is null").select("row", F.lit("edited").alias("pair"), F.col("keys").alias("a"), F.col("edited_keys").alias("b"))
    pairs = pairs.union(again.where("next is null").select("row", F.lit("next").alias("pair"), F.col("keys").alias("a"), F.col("next_keys").alias("b")))
    more = likenesses(pairs, third).groupBy("row").agg(F.max(F.when(F.col("pair") == "edited", F.col("near"))).alias("edited_again"), F.max(F.when(F.col("pair") == "next", F.col("near"))).alias("next_again"))
    return first.join(more, "row", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                  F.coalesce("edited", "edited_again").alias("near_edited"), F.coalesce("next", "next_again").alias("near_next"))
