"""Single steps of the document operators."""
import random

from dialoom.llm import components, jaccard_join as jj, minhash, simhash
from dialoom.llm.common import stage


def changed(r, words, n):
    copy = list(words)
    for i in r.sample(range(len(words)), n):
        copy[i] = f"v{r.randrange(10**9)}"
    return copy


def test_a_family_has_few_pairs_of_nodes_and_hubs(table, monkeypatch):
    """Every member shares its lists with many hubs; two of them are compared by bitmaps."""
    r, asked = random.Random(31), []
    centre = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(changed(r, centre, 4)), "en") for i in range(300)]
    bounded = jj._bounded
    monkeypatch.setattr(jj, "_bounded", lambda pairs, sets: asked.append(pairs.count()) or bounded(pairs, sets))
    got = jj.op13(table(rows)).collect()
    assert asked[0] <= 2 * len(rows)
    assert {x.component_id for x in got} == {0}


def test_near_copies_come_from_fingerprints_first(table, monkeypatch):
    """The SimHash links of the near-copy stage are those of all pairs at most 4 bits apart, and they are decided before MinHash keys."""
    r, seen = random.Random(32), []
    rows = []
    for f in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [(10 * f + i, " ".join(changed(r, words, i)), "en") for i in range(4)]
    links = minhash.links
    monkeypatch.setattr(minhash, "links", lambda nodes, texts, likely, n: seen.append(stage(likely)) or links(nodes, texts, likely, n))
    kept = simhash.drop_near_duplicates(table(rows))
    assert sorted(x.doc_id for x in kept.collect()) == [10 * f for f in range(30)]
    nodes = {minhash.node(minhash.shingles(t.encode(), 5)): simhash.simhash(t.encode(), 5)[0] % 2**64 for _, t, _ in rows}
    root = {x.node: x.root for x in components.components(seen[0], "a", "b").collect()}
    close = [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 4]
    assert len(close) > 20 and all(root[a] == root[b] for a, b in close)


def test_shingle_hashes_follow_the_shingles():
    r = random.Random(33)
    for n in (1, 2, 3, 4, 5, 9, 400):
        words = [r.choice("abc") for _ in range(n)]
        want = {tuple(words[i:i + 4]) for i in range(max(1, n - 3))}
        assert len(minhash.shingles(" ".join(words).upper().encode(), 4)) == len(want)
    one, two = (set(minhash.shingles(t, 2).tolist()) for t in (b"a b c d", b"x b c y"))
    assert len(one & two) == 1 and not set(minhash.shingles(b"b a", 2).tolist()) & set(minhash.shingles(b"a b", 2).tolist())
    assert not set(minhash.shingles(b"a a", 3).tolist()) & set(minhash.shingles(b"a a a", 3).tolist())
