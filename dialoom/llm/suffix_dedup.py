"""Exact substring deduplication with longest-previous-factor arrays.

Every byte covered by a string of `length` bytes that also starts earlier (in a document with a smaller id, or
earlier in the same one) is removed; all strings are judged on the input. One suffix array over a whole corpus
fits no task, so strings are first dealt out so that equal ones meet:

1. Each window of `length` bytes has an anchor: of its k-byte grams the one with the smallest hash, leftmost on
   ties. Equal windows have equal anchors at equal places. Neighbouring windows mostly share one, so a document
   becomes a short list of items: an anchor and the run of windows it serves. Items are dealt by the anchor's hash.
2. Items with equal anchor and equal bytes around it (copies, the insides of repeated passages) repeat the first of
   them as a whole. Anchors found once can't repeat anything. What remains are anchors with different surroundings.
3. For those the bytes of the runs are fetched. In each task, the suffixes at the windows are sorted to depth `length`
   (by prefix doubling). The longest previous factor of a suffix is its longest match with the previous or next
   suffix in that order that starts earlier in the text. Ties stand in text order, so a factor of full depth can
   only come from the predecessor, and a window is a repeat if and only if it has one inside its tie.
   Anchors with very many different surroundings are not gathered in one task: each of their windows becomes an
   item of its own, dealt by its hash, and step 2 settles it.

Hashes are 64 bits for the anchor and another 64 for the bytes around it. Texts travel compressed (zstd).
Null text is empty. Rows equal in doc_id and text are one document and get the same result; a doc_id with several
texts is several documents, in the order of a hash of the text. A null doc_id comes first. Matches never cross
documents; documents shorter than `length` stay whole.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, fresh, mix, stage, tidy, with_text

CHUNK = 1 << 18  # bytes whose windows are looked at together; positions inside fit 18 bits
ITEM = "h bigint, c bigint, d bigint, t int, w bigint, more array<struct<d: bigint, t: int, w: bigint>>"
NAMES = ["h", "c", "d", "t", "w"]


def pack_run(start, windows, before=0):
    """A run of windows as one number: where it starts, how many (under 256), and the bytes from its start to the anchor."""
    return start << 16 | windows << 8 | before


def _chunks(texts: list, length: int) -> Iterator[list]:
    """Lists of (document, start, bytes) with at most CHUNK bytes; long documents in pieces that share length - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = text or b""
        for s in range(0, max(0, len(text) - length + 1), CHUNK - length + 1):
            part = text[s:s + CHUNK]
            if size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, s, part))
            size += len(part)
    if held:
        yield held


def anchors(texts: list, length: int, k: int):
    """Arrays h, c, document, w: the items of all texts."""
    out = []
    for held in _chunks(texts, length):
        data = b"".join(p for _, _, p in held)
        lens = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(lens)
        n = len(data) - k + 1
        word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) if len(data) >= 8 else None
        gram = np.zeros(n, np.uint64)
        for j in range(0, k, 8):
            gram = (gram ^ word[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        gram = mix(gram, 1)
        least = (gram & ~np.uint64(CHUNK - 1)) | np.arange(n, dtype=np.uint64)
        span, width = 1, length - k + 1
        while span < width:  # minimum over `width` positions, by doubling
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        valid = np.zeros(len(least) + 1, bool)
        owner = np.repeat(np.arange(len(held)), lens)[:len(least)]
        valid[:-1] = np.arange(len(least)) + length <= ends[owner]
        anchor = (least & np.uint64(CHUNK - 1)).astype(np.int64)
        at = np.flatnonzero(valid[:-1])
        first = np.ones(len(at), bool)
        first[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
        start = at[first]
        runs = np.diff(np.append(np.flatnonzero(first), len(at)))
        a = anchor[start]
        h64 = xxhash.xxh3_64_intdigest
        c = np.array([h64(data[s:e]) for s, e in zip(start.tolist(), (start + runs - 1 + length).tolist())], np.uint64)
        c = mix(c, 2) ^ mix((a - start).astype(np.uint64) << np.uint64(8) | runs.astype(np.uint64), 3)
        part = owner[start]
        base = ends - lens
        shift = np.array([s for _, s, _ in held])
        doc = np.array([i for i, _, _ in held])[part]
        out.append((gram[a].view(np.int64), c.view(np.int64), doc, pack_run(start - base[part] + shift[part], runs, a - start)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _collapsed(h, c, d, t, w) -> pa.RecordBatch:
    """Items of one batch; of equal (h, c) only the first travels, with the others listed in it."""
    order = np.lexsort((w, t, d, c, h))
    h, c, d, t, w = (x[order] for x in (h, c, d, t, w))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    other = ~new & ((d != d[lead]) | (t != t[lead]) | (w != w[lead]))  # not the same place of an equal row
    firsts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    offsets = np.append(0, np.cumsum(np.bincount(group[other], minlength=len(firsts)))) if len(firsts) else np.array([0])
    more = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(d[other]), pa.array(t[other]), pa.array(w[other])], names=["d", "t", "w"]))
    return pa.record_batch([*(pa.array(x[firsts]) for x in (h, c, d, t, w)), more], names=[*NAMES, "more"])


def _resolve(batches):
    """From items sorted by h, c, d, t, w: kind 0 (repeats an earlier item as a whole), kind 1 (its anchor has other surroundings too).

    Only the current class's first item is carried from batch to batch.
    """
    first = None  # (h, c, d, t, w) of the class that was open at the end of the last batch, and whether it is known to be kind 1
    known = False
    out = []

    def rows(kind, h, d, t, w):
        out.append(pa.record_batch([pa.array(np.full(len(d), kind, np.int32)), pa.array(h), pa.array(d), pa.array(t), pa.array(w)], names=["kind", "h", "d", "t", "w"]))

    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, d, t, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if first is not None:
            h, c, d, t, w = (np.append(x, y).astype(y.dtype) for x, y in zip(first, (h, c, d, t, w)))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = ~new & ((d != d[lead]) | (t != t[lead]) | (w != w[lead]))
        rows(0, h[later], d[later], t[later], w[later])
        more = batch.column(5).flatten()
        if len(more):
            md, mt, mw = (f.to_numpy(zero_copy_only=False) for f in more.flatten())
            rows(0, np.zeros(len(md), np.int64), md, mt, mw)
        f = np.flatnonzero(new)
        same = h[f[1:]] == h[f[:-1]]
        border = np.append(False, same) | np.append(same, False)
        if first is not None and known:
            border[0] = False  # told already
            known_now = bool(same[-1]) if len(same) else True
        else:
            known_now = bool(border[-1])
        told = f[border]
        rows(1, h[told], d[told], t[told], w[told])
        last = f[-1]
        first, known = tuple(np.array([x[last]], dtype=x.dtype) for x in (h, c, d, t, w)), known_now
        yield from out
        out.clear()
    tidy()


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def repeated_windows(texts: list, counts: np.ndarray, length: int) -> np.ndarray:
    """Whether each window repeats an earlier one. Text i has counts[i] windows, from its first byte on; texts stand in order.

    The suffixes are ranked by their first 8, 16, 32, ... bytes, then by `length` bytes, with ties in text order.
    """
    data = b"".join(texts) + bytes(length + 8)
    n = len(data) - 8
    rank, depth = _rank(np.ndarray(n, ">u8", data, strides=(1,)).astype(np.uint64)), 8
    while 2 * depth <= length:
        rank = _rank(rank[:-depth] << np.uint64(32) | rank[depth:])
        depth *= 2
    lens = np.array([len(x) for x in texts])
    base = np.repeat(np.cumsum(lens) - lens, counts)
    start = base + np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = rank[start] << np.uint64(32) | rank[start + length - depth]
    order = np.argsort(full, kind="stable")  # suffix order to this depth
    has_previous = np.zeros(len(start), bool)
    has_previous[order[1:]] = full[order[1:]] == full[order[:-1]]  # the predecessor starts earlier and matches to full depth
    return has_previous


def _factors(length: int, at_once: int):
    """From contexts sorted by h, d, t, w: the runs of windows that repeat earlier ones."""
    def run(batches):
        held, size, last = [], 0, None

        def settle():
            texts, d, t, w = zip(*held)
            d, t, w = np.array(d), np.array(t, np.int32), np.array(w)
            counts = w >> 8 & 255
            gone = repeated_windows(texts, counts, length)
            owner = np.repeat(np.arange(len(counts)), counts)
            inside = np.arange(len(gone)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.flatnonzero(gone)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            begin = at[new]
            many = np.diff(np.append(np.flatnonzero(new), len(at)))
            o = owner[begin]
            return pa.record_batch([pa.array(d[o]), pa.array(t[o]), pa.array(pack_run((w[o] >> 16) + inside[begin], many))], names=["d", "t", "w"])

        for batch in batches:
            for h, d, t, w, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= at_once and h != last:
                    yield settle()
                    held, size = [], 0
                held.append((text, d, t, w))
                size += len(text)
                last = h
        if held:
            yield settle()
        tidy()
    return run


def _portions(batches, column: int, size=4 << 20):
    """Slices of the batches with about `size` bytes of text at most (or one row)."""
    for batch in batches:
        ends = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())])
        begin = 0
        while begin < batch.num_rows:
            until = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, side="right")))
            yield batch.slice(begin, until - begin)
            begin = until


def _zipped(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.array([z.compress(x or b"") for x in byte_texts(batch)], pa.binary())
        tidy()

    return run(text)


def _keyed(docs: DataFrame) -> list:
    """The columns d and t, the order of documents."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("d"),
            F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32).cast("int").alias("t")]


def repeated_runs(docs: DataFrame, length: int, k: int, at_once=1 << 19, spread=8192) -> DataFrame:
    """d, t, w: runs of windows (see pack_run) that repeat earlier ones. Anchors with over `spread` surroundings are dealt window by window."""
    keyed = docs.select(*_keyed(docs), "text")

    def items(batches):
        for batch in _portions(batches, 2):
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            h, c, doc, w = anchors(byte_texts(batch.column(2)), length, k)
            yield _collapsed(h, c, d[doc], t[doc], w)
        tidy()

    def settled(found):
        dealt = found.repartition("h").sortWithinPartitions("h", "c", "d", "t", "w")
        return dealt.mapInArrow(_resolve, "kind int, h bigint, d bigint, t int, w bigint")

    found = stage(settled(keyed.mapInArrow(items, ITEM)))
    whole = found.where("kind = 0").select("d", "t", "w")
    open_ends = found.where("kind = 1").select("h", "d", "t", "w")
    hot = stage(open_ends.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > spread).select("h"))
    wanted = open_ends.join(hot.withColumn("hot", F.lit(True)), "h", "left").groupBy("d", "t").agg(F.collect_list(F.struct("h", "w", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("items"))
    texts = keyed.select("d", "t", _zipped(F.col("text")).alias("z")).join(wanted, ["d", "t"])

    def contexts(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for d, t, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = z.decompress(text)
                rows = [(x["h"], d, t, x["w"], text[x["w"] >> 16:(x["w"] >> 16) + (x["w"] >> 8 & 255) - 1 + length], x["hot"]) for x in own]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()))], names=["h", "d", "t", "w", "text", "hot"])
        tidy()

    fetched = stage(texts.mapInArrow(contexts, "h bigint, d bigint, t int, w bigint, text binary, hot boolean"))
    dealt = fetched.where("not hot").select("h", "d", "t", "w", "text").repartition("h").sortWithinPartitions("h", "d", "t", "w")
    factors = dealt.mapInArrow(_factors(length, at_once), "d bigint, t int, w bigint")

    def windows(batches):
        for batch in batches:
            d, t, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = w >> 8 & 255
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            texts = batch.column(3).to_pylist()
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[i][j:j + length]) for i, j in zip(row.tolist(), inside.tolist())), np.int64).reshape(-1, 2)
            yield _collapsed(digest[:, 0], digest[:, 1], d[row], t[row], pack_run((w[row] >> 16) + inside, 1))

    single = settled(fetched.where("hot").select("d", "t", "w", "text").mapInArrow(windows, ITEM)).where("kind = 0").select("d", "t", "w")
    return whole.union(factors).union(single)


def removed(text: bytes, runs: list, length: int) -> tuple:
    """Kept bytes, number of removed bytes and of maximal removed spans."""
    edge = np.zeros(len(text) + 1, np.int64)
    w = np.array(runs, np.int64)
    np.add.at(edge, w >> 16, 1)
    np.add.at(edge, (w >> 16) + (w >> 8 & 255) - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def dedup(docs: DataFrame, length=100, k=32, as_text=False, **more) -> DataFrame:
    """All columns of `docs` but text, plus suffix_dedup: kept (binary), n_bytes, n_removed, n_spans.

    With `as_text` kept is a string; where a cut splits a character, its remaining bytes go too.
    """
    d, t, z, w, out = (fresh(docs, f"suffix_{x}") for x in ("d", "t", "z", "w", "dedup"))
    runs = repeated_runs(docs, length, k, **more).groupBy("d", "t").agg(F.collect_list("w").alias("runs")).select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(w))
    key_d, key_t = _keyed(docs)
    packed = docs.select(*[c for c in docs.columns if c != "text"], key_d.alias(d), key_t.alias(t), _zipped(F.col("text")).alias(z))

    kind = pa.string() if as_text else pa.binary()

    @F.arrow_udf(f"struct<kept: {'string' if as_text else 'binary'}, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unzip = zstandard.ZstdDecompressor()
        for texts, found in batches:
            rows = []
            for text, own in zip(texts, found):
                text, own = unzip.decompress(text.as_py()), own.as_py()
                kept, gone, spans = removed(text, own, length) if own else (text, 0, 0)
                rows.append((kept.decode("utf-8", "ignore") if as_text else kept, len(text), gone, spans))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64()))], names=["kept", "n_bytes", "n_removed", "n_spans"])
        tidy()

    return packed.join(runs, [d, t], "left").withColumn(out, apply(F.col(z), F.col(w))).drop(d, t, z, w)


def drop_repeated_passages(docs: DataFrame, length=100) -> DataFrame:
    """`docs` with later copies of repeated strings taken out."""
    done = dedup(docs, length, as_text=True)
    return with_text(done, F.col(done.columns[-1])["kept"]).select(*docs.columns)


def op6(docs: DataFrame) -> DataFrame:
    done = dedup(docs.select("doc_id", "text"), length=100)
    return done.select("doc_id", "suffix_dedup.n_bytes", "suffix_dedup.n_removed", "suffix_dedup.n_spans", F.sha2("suffix_dedup.kept", 256).alias("kept_sha256"))
