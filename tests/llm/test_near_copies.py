"""The near-copy stage against all pairs by exact five-word shingle Jaccard similarity, without the operator's own functions."""
import random
from fractions import Fraction

import pytest

import corpus_pipeline
from dialoom.llm import minhash, simhash


def shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    k = min(5, len(words))
    return frozenset(b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b)) if a or b else Fraction(1)


def jaccard_groups(texts):
    """Per text the place of the first one of its group, by all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(sets)):
        for i in range(j):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= Fraction(4, 5):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def changed(r, words, n):
    """A copy with n changed words."""
    copy = list(words)
    for i in r.sample(range(len(words)), n):
        copy[i] = f"v{r.randrange(10**9)}"
    return copy


def kept_ids(docs):
    return sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect())


def test_recall_and_wrong_merges_on_planted_pairs(table):
    r = random.Random(21)
    rows, alike = [], []
    for p in range(600):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([40, 120, 300]))]
        pair = [" ".join(words), " ".join(changed(r, words, round(len(words) * r.uniform(0.003, 0.06))))]
        rows += [(2 * p, pair[0], "en"), (2 * p + 1, pair[1], "en")]
        alike.append(jaccard(*map(shingles, pair)))
    assert sum(Fraction(3, 5) <= x < Fraction(4, 5) for x in alike) > 100 and sum(Fraction(4, 5) <= x <= Fraction(19, 20) for x in alike) > 100
    kept = set(kept_ids(table(rows)))
    lost = [float(x) for p, x in enumerate(alike) if x >= Fraction(4, 5) and 2 * p + 1 in kept]
    wrong = [float(x) for p, x in enumerate(alike) if x < Fraction(4, 5) and 2 * p + 1 not in kept]
    assert not lost and not wrong and all(2 * p in kept for p in range(600))


def test_families_chains_and_the_bound_itself(table):
    r = random.Random(22)
    texts = []
    for _ in range(3):  # some members hang together over others only, some not at all
        centre = [f"w{r.randrange(10**6)}" for _ in range(150)]
        texts += [" ".join(changed(r, centre, r.randrange(0, 12))) for _ in range(45)]
    for n, m in ((40, 50), (39, 49), (4, 5), (8, 10)):  # prefixes: 40 of 50 shingles are 0.8 exactly, 39 of 49 less
        words = [f"x{r.randrange(10**6)}" for _ in range(m + 4)]
        texts += [" ".join(words), " ".join(words[:n + 4])]
    step = [f"y{r.randrange(10**6)}" for _ in range(120)]
    texts += [" ".join(step[i:i + 60]) for i in range(0, 60, 5)]  # each alike to its neighbours only
    texts += ["a b a b a b a b a b", "a b a b a b", None, "", " \n", "one two", "ONE  two", "one"]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    want = jaccard_groups(texts)
    assert kept_ids(table([(i, t, "en") for i, t in enumerate(texts)])) == sorted(set(want))


def test_nodes_with_an_equal_first_word_stay_apart(table):
    """The old nodes were 64 bits of a SimHash, equal for texts whose shingles differ little."""
    r = random.Random(23)
    words = [f"w{r.randrange(10**6)}" for _ in range(40)]
    tails = [[f"t{r.randrange(10**6)}" for _ in range(8)] for _ in range(60)]
    texts = [" ".join(words + t) for t in tails]  # 36 of 52 different shingles in common: 0.69
    assert kept_ids(table([(i, t, "en") for i, t in enumerate(texts)])) == list(range(60))


@pytest.mark.parametrize("n", [1, 60, 3000])
def test_keys_meet_for_alike_sets(n):
    r = random.Random(n)
    words = [f"w{r.randrange(10**6)}" for _ in range(n)]
    copy = " ".join(words[:-1] if n > 5 else words)
    a, b = (minhash.keys(minhash.shingles(t.encode(), 5)) for t in (" ".join(words), copy))
    assert len(a) == len(b) == minhash.BANDS and len(set(a)) == len(a) and any(x == y for x, y in zip(a, b))
    assert minhash.keys(minhash.shingles(b" ", 5)) == []


def test_pipeline_stage_by_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = corpus_pipeline.line_dedup(spark, docs, sf_dir).toPandas().sort_values("doc_id")
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(lines.to_dict("records"), docs.schema), sf_dir)
    ids = lines.doc_id.tolist()
    assert sorted(x["doc_id"] for x in kept.collect()) == [ids[i] for i in sorted(set(jaccard_groups(lines.text.tolist())))]
