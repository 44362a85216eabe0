"""Lines, near copies, repeated passages and the pipeline."""
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm import components, line_dedup, simhash, suffix_dedup


def test_cuckoo_adds_and_removes():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    f = line_dedup.Cuckoo.for_keys(len(keys))
    assert f.add(keys) and f.has(keys).all()
    f.remove(keys[:1500])
    assert f.has(keys[1500:]).all() and f.has(keys[:1500]).mean() < 0.01


def test_line_store_is_reversible(spark, table):
    base = table([(i, f"Cookie notice \nown line {i}\n cookie NOTICE", "en") for i in range(9)])
    more = table([(100 + i, "cookie notice\nanother", "en") for i in range(12)])
    store = line_dedup.LineStore.empty(spark, min_docs=10, shards=4).insert(base)
    assert store.common().count() == 0
    both = store.insert(more)
    assert both.common().count() == 2  # the notice and `another`
    assert line_dedup.drop_common_lines(base, both).where("text like '%ookie%'").count() == 0
    back = both.delete(more)
    assert back.common().count() == 0 and line_dedup.drop_common_lines(base, back).exceptAll(base).count() == 0
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, store.counts.collect()))


def test_lines_without_broadcast(spark, table):
    docs = table([(i, f"x\nline {i % 2}\n\n", "en") for i in range(20)])
    store = line_dedup.LineStore.of(docs, min_docs=10)
    plain = docs.select(F.explode(store.screen(F.col("text"), broadcast_bytes=0)).alias("key")).join(store.common(), "key").count()
    assert plain == docs.select(F.explode(store.screen(F.col("text"))).alias("key")).join(store.common(), "key").count() == 40


def test_lines_odd(odd, none):
    got = line_dedup.op8(odd).toPandas()
    assert len(got) == 11 and (got.n_dropped == 0).all() and got[got.doc_id == 1].n_lines.iloc[0] == 1
    assert line_dedup.op8(none).count() == 0
    clash = odd.withColumns({"line_doc": F.lit(1), "key": F.lit("k"), "gone": F.lit(0)})
    assert line_dedup.drop_common_lines(clash, line_dedup.LineStore.of(clash)).columns == clash.columns


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(500, 500)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def slow_simhash(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    f = np.array(prints, np.uint64)
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= distance, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def jaccard_groups(texts, k=5):
    """Groups by all pairs of equal or alike sets of word shingles, similarity 0.8 or more."""
    sets = []
    for t in texts:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 9 >= (len(sets[i]) + len(sets[j])) * 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("bucket, block, segments", [(64, 1024, None), (2, 5, 3), (3, 8, 2), (2, 4, 5)])
def test_links_hold_groups_together(spark, bucket, block, segments):
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(25)]
    prints = list({c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(12)} | set(centres))
    prints = [p % 2**64 for p in prints]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    links = simhash.links(df, 4, segments, bucket, block)
    got = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    want = near_groups(prints, 4)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash(spark, odd, none, table):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("a Bc dé F g h i".split(" ")) for _ in range(r.choice([0, 1, 3, 4, 9, 60]))), "en") for i in range(150)]
    got = simhash.op4(table(docs)).toPandas().sort_values("doc_id")
    prints = [slow_simhash(t, 4) for _, t, _ in docs]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == near_groups(prints, 4)
    assert simhash.op4(none).count() == 0 and simhash.op4(odd).count() == 11
    kept = simhash.drop_near_duplicates(odd.withColumns({"fp": F.lit(1), "row": F.lit(2)}))
    assert kept.columns == ["doc_id", "text", "lang", "fp", "row"]
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (1, 2, 3)").count() == 1


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(data[s:s + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept)
    return out


@pytest.mark.parametrize("spread, at_once, k, chunk", [(8192, 1 << 20, 8, 1 << 20), (3, 500, 16, 1 << 20), (8192, 100, 8, 256)])
def test_repeated_passages(spark, spread, at_once, k, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk) if chunk != 1 << 20 else None
    r = random.Random(8)
    shared = ["".join(r.choice("abcdefgh é") for _ in range(150)) for _ in range(4)]
    rows = [(i, "".join(r.choice(["ab", "b", "a", r.choice(shared), "xyz" * r.randint(1, 30), str(r.random())]) for _ in range(r.choice([0, 1, 5, 20])))) for i in range(60)]
    rows += [(100 + n, "q" * n) for n in (39, 40, 41, 500)] + [(200, rows[7][1]), (201, None)]
    done = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 40, k, spread=spread, at_once=at_once)
    got = {r["doc_id"]: (r[1]["n_bytes"], r[1]["n_removed"], r[1]["n_spans"], bytes(r[1]["kept"])) for r in done.collect()}
    assert got == brute(rows, 40)


def test_repeated_passages_odd(odd, none):
    got = suffix_dedup.op6(odd).toPandas()
    assert len(got) == 11 and suffix_dedup.op6(none).count() == 0
    assert got[got.doc_id == 8].n_removed.iloc[0] == 598  # from byte 2 on
    clash = odd.withColumns({"suffix_d": F.lit(1), "d": F.lit(2), "n_chars": F.lit(0).cast("bigint")})
    cut = suffix_dedup.drop_repeated_passages(clash)
    assert cut.columns == clash.columns and cut.where("n_chars <> coalesce(length(text), 0)").count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage against a plain computation on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf_dir).toPandas()
    whole = docs.toPandas()
    gone = whole[~whole.doc_id.isin(kept.doc_id)]
    assert len(gone) <= 0.02 * len(whole) and list(kept.columns) == docs.columns

    def read(pdf):
        return spark.createDataFrame(pdf.to_dict("records"), docs.schema)

    lines = corpus_pipeline.line_dedup(spark, read(kept), sf_dir).toPandas().sort_values("doc_id")
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).lower() if x.isascii() else None
    every = [{line_dedup.line_key(x.encode()) for x in t.split("\n")} for t in kept.text]
    common = {k for k, n in pd.Series([k for s in every for k in s]).value_counts().items() if n >= 10 and k}
    want = ["\n".join(x for x in t.split("\n") if line_dedup.line_key(x.encode()) not in common) for t in kept.sort_values("doc_id").text]
    assert lines.text.tolist() == want and key("Ab ") == "ab" and (lines.n_chars == lines.text.str.len()).all()

    near = corpus_pipeline.near_dedup(spark, read(lines), sf_dir).toPandas().sort_values("doc_id")
    groups = jaccard_groups(lines.text)
    ids = lines.doc_id.tolist()
    assert near.doc_id.tolist() == [ids[i] for i in sorted(set(groups))]

    cut = corpus_pipeline.suffix_dedup(spark, read(near), sf_dir).toPandas().sort_values("doc_id")
    want = brute(list(zip(near.doc_id, near.text)), 100)
    assert [hashlib.md5(t.encode()).hexdigest() for t in cut.text] == [hashlib.md5(want[i][3].decode("utf-8", "ignore").encode()).hexdigest() for i in cut.doc_id]

    packed = corpus_pipeline.packing(spark, read(cut), sf_dir).toPandas()
    assert packed.groupby("doc_id").length.sum().sum() == packed.drop_duplicates("doc_id").doc_tokens.sum() and packed.doc_id.nunique() == len(cut)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
