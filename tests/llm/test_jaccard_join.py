"""The size-aware Jaccard join against all pairs."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import jaccard_join as jj
from dialoom.llm.minhash import shingles


def slow_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def slow(rows):
    sets, root = [slow_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(repr((d, len(s), least[find(i)] if s else d)) for i, ((d, _, _), s) in enumerate(zip(rows, sets)))


def made(seed, families=14, size=9):
    """Families of copies with more and more changes, of many lengths, with a passage in most of them."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for f in range(families):
        n = r.choice([3, 5, 8, 10, 14, 20, 33, 60, 150, 400])
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(size):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, n // 40, n // 25])):
                at, what = r.randrange(len(copy)), r.random()
                if what < 0.5:
                    copy[at] = f"v{r.randrange(10**6)}"
                elif what < 0.75:
                    copy.insert(at, f"v{r.randrange(10**6)}")
                elif len(copy) > 1:
                    del copy[at]
            if r.random() < 0.5 and n > 50:
                copy = copy + passage
            rows.append((len(rows) * 3 % 1009, (" " if r.random() < 0.5 else "\n").join(copy).replace("w", r.choice("wW")), "en"))
    return rows


@pytest.mark.parametrize("seed, pairs_up_to, crowded, block", [(1, None, 64, 1024), (2, 0, 2, 4), (3, 70, 3, 1024), (4, 500, 2, 5)])
def test_join_equals_all_pairs(table, seed, pairs_up_to, crowded, block, monkeypatch):
    for name, value in (("FREQUENT", 5), ("CROWDED", crowded), ("BLOCK", block)):
        monkeypatch.setattr(jj, name, value)
    rows = made(seed)
    got = jj.jaccard_join(table(rows), pairs_up_to=pairs_up_to).drop("node")
    assert sorted(repr(tuple(r)) for r in got.collect()) == slow(rows)


def test_chains_and_close_calls(table, monkeypatch):
    """Chains whose ends don't link, and pairs on both sides of the limit."""
    r, rows = random.Random(5), []
    for n in (30, 100):
        words = [f"x{n}_{i}" for i in range(n)]
        for step in range(12):
            rows.append((len(rows), " ".join(words), "en"))
            words = words[max(1, n // 30):] + [f"y{n}_{step}_{i}" for i in range(max(1, n // 30))]
    for i in range(40):
        n = r.randint(8, 60)
        words = [f"z{i}_{k}" for k in range(n)]
        rows += [(len(rows), " ".join(words), "en"), (len(rows) + 1, " ".join(words[:n - round((n - 3) * r.uniform(0.1, 0.2))]), "en")]
    assert sorted(repr(tuple(x)) for x in jj.op13(table(rows)).collect()) == slow(rows)


@pytest.mark.parametrize("changes", [(1, 2, 2), (2, 2, 2, 1)])
def test_a_crowd_of_near_copies_is_not_decided_pair_by_pair(table, changes, monkeypatch):
    """In a family of which most pairs may link few of them are compared by their texts."""
    for name, value in (("FREQUENT", 5), ("CROWDED", 8), ("BLOCK", 64)):
        monkeypatch.setattr(jj, name, value)
    r, rows, asked = random.Random(11), [], []
    words = [f"f{i}" for i in range(200)]
    for i in range(150):
        copy = list(words)
        for at in r.sample(range(len(copy)), r.choice(changes)):
            copy[at] = f"g{i}_{at}"
        rows.append((i, " ".join(copy), "en"))
    decide = jj._decided

    def counted(pairs, sets, docs):
        asked.append(pairs.count())
        return decide(pairs, sets, docs)

    monkeypatch.setattr(jj, "_decided", counted)
    got = jj.op13(table(rows)).collect()
    assert sorted(repr(tuple(x)) for x in got) == slow(rows)
    assert sum(asked) < 20 * len(rows), asked


def test_beginnings_hold_the_common_shingles():
    r = np.random.default_rng(3)
    for _ in range(3000):
        n = int(r.integers(6, 120))
        m = int(r.integers(n, n * 20 // 17 + 1))
        common = -(-17 * (n + m) // 37)
        if common > n:
            continue
        universe = r.permutation(n + m - common)
        small, large = np.sort(universe[:n]), np.sort(np.append(universe[:common], universe[n:]))
        shared = np.sort(universe[:common])
        for k in (1, 2):
            assert shared[k - 1] in small[:jj.begin(n, k, False)] and shared[k - 1] in large[:jj.begin(m, k, True)] and shared[k - 1] in small[:jj.begin(n, k, True)]


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(4)
    for n in (6, 100, 700):
        x = r.integers(0, 2**64, n, dtype=np.uint64)
        y = np.append(x[: n - n // 10], r.integers(0, 2**64, n // 12, dtype=np.uint64))
        a, b = jj.bitmap(x), jj.bitmap(y)
        if len(a) > len(b):
            a = a[:len(b)] ^ a[len(b):]
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_boundary_grows_with_the_lists():
    assert 0 < jj.boundary(0) < jj.boundary(5) < jj.boundary(50) <= jj.PAIRS_MOST


def test_rows_that_share_a_key():
    import pyarrow as pa
    r = np.random.default_rng(1)
    rows = sorted((int(k), int(n)) for k, n in zip(r.integers(0, 40, 90), r.integers(0, 9, 90)))
    one = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([n for _, n in rows])], names=["key", "node"])
    for size in (1, 2, 7, 90):
        parts = [one.slice(i, size) for i in range(0, 90, size)]
        got = [(k, n) for b in jj._shared_only(iter(parts)) for k, n in zip(b.column("key").to_pylist(), b.column("node").to_pylist())]
        several = {k for k in {k for k, _ in rows} if len({n for q, n in rows if q == k}) > 1}
        assert got == [x for x in sorted(set(rows)) if x[0] in several]


def test_odd(odd, none):
    got = jj.op13(odd).toPandas()
    assert len(got) == 11 and jj.op13(none).count() == 0
    assert got[got.n_shingles == 0].component_id.tolist() == got[got.n_shingles == 0].doc_id.tolist()
    clash = odd.withColumns({"node": F.lit(1), "n": F.lit(2), "row": F.lit("x")})
    assert jj.op13(clash).columns == ["doc_id", "n_shingles", "component_id"]
    assert len(shingles(b"a b", 4)) == 1
