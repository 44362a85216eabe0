"""The conversation trie against rebuilt conversations held in memory."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[:len(p)] == p]
        ends = sorted(c for c in members if len(full[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in under),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def made(n, seed):
    r = random.Random(seed)
    words = ["", "hi", "hé 🙂", "a longer text", None]
    rows = []
    for c in r.sample(range(-50, 700), n) + [10**12, 10**12 + 3]:
        for t in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(words)))
    copy = [x for x in rows if x[0] == rows[0][0]]
    rows += [(5000 + i, *x[1:]) for i in range(6) for x in copy] + rows[:5] + [(None, 1, "user", "lost")]
    return rows


def got(spark, rows):
    return sorted(repr(tuple(r)) for r in prefix_trie.op11(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


@pytest.mark.parametrize("n, seed", [(90, 1), (12, 2)])
def test_trie_equals_rebuilt_conversations(spark, n, seed):
    rows = made(n, seed)
    assert got(spark, rows) == slow(rows)


def test_long_conversation_and_many_copies(spark):
    rows = [(100 + c, t, "user", f"turn {t % 7}") for c in range(3) for t in range(60)] + [(1000 + c, 0, "user", "same") for c in range(150)]
    assert got(spark, rows) == slow(rows)


def test_equal_hashes_are_found_and_hashed_anew(spark, monkeypatch):
    rows, real, seeds = made(30, 3), prefix_trie.turn_hash, []

    def weak(role, text, seed):
        seeds.append(seed)
        return [F.lit(5).cast("bigint") + F.length(text)] * 4 if seed == 0 else real(role, text, seed)

    monkeypatch.setattr(prefix_trie, "turn_hash", weak)
    assert got(spark, rows) == slow(rows) and seeds == [0, 1]


def test_equal_fingerprints_are_found(spark, monkeypatch):
    rows, real, seeds = made(30, 4), prefix_trie.bases, []

    def flat(seed):
        seeds.append(seed)
        return [1] * 4 if seed == 0 else real(seed)  # with base 1 the order of turns doesn't count

    rows += [(9001, 0, "user", "a"), (9001, 1, "user", "b"), (9001, 2, "user", "c"), (9001, 3, "user", "d"), (9001, 4, "user", "e"), (9001, 5, "user", "f"), (9001, 6, "user", "g"),
             (9003, 0, "user", "a"), (9003, 1, "user", "b"), (9003, 2, "user", "c"), (9003, 3, "user", "d"), (9003, 4, "user", "e"), (9003, 5, "user", "g"), (9003, 6, "user", "f")]
    monkeypatch.setattr(prefix_trie, "bases", flat)
    assert got(spark, rows) == slow(rows) and set(seeds) == {0, 1}


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = [-20, -3, 0, 5, 6, 7, 8, 9, 10, 100, 1000, 99]
    df = spark.createDataFrame([(2, 1, 1, i) for i in ids] + [(2, 1, 2, 4)], "depth bigint, f1 bigint, f2 bigint, conv bigint")
    found = {r.f2: r.ends for r in prefix_trie.ends_digests(df).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 2: hashlib.sha256(b"4").hexdigest()}


def test_powers():
    e = np.array([0, 1, 2, 31, 1000, 2**33])
    assert prefix_trie.powers(12345, e).tolist() == [pow(12345, int(x), prefix_trie.PRIME) for x in e]


def test_odd(spark):
    assert prefix_trie.op11(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(7, None, None, None)], SCHEMA).withColumns({"depth": F.lit("x"), "f1": F.lit(1), "i": F.lit(2), "n_convs": F.lit(3)})
    assert sorted(repr(tuple(r)) for r in prefix_trie.op11(wide).collect()) == slow([(7, None, None, None)])
    long = [(1, t, "user", "x" * 200_000) for t in range(3)]
    assert got(spark, long) == slow(long)
