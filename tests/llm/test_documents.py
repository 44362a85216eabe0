"""Language, rules, quality and toxicity."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import language_id, quality_classifier, quality_rules, toxicity

WORDS = {"en": "the of and to in is that was for with house river stone paper", "de": "der die und das nicht mit ein auf haus fluss stein papier über", "fr": "le la les et des un une dans que maison pierre été très"}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(240):
        lang = r.choice(list(WORDS))
        toxic, bad = i % 4 == 0, i % 3 == 0
        text = prose(r, lang, r.randint(25, 90)) + (" You are an idiot and a stup1d moron!" if toxic else "")
        rows.append((i, text + (" ### $$$ %%% ***" * 12 if bad else ""), lang))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_language(labelled):
    docs, _ = labelled
    got = language_id.op9(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got.held_out.any() and (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd(spark, odd, none, labelled):
    assert language_id.op9(none).count() == 0
    got = language_id.op9(odd.unionByName(labelled[0].withColumn("doc_id", F.col("doc_id") + 100))).toPandas()
    assert len(got) == 251
    und = got[got.lang_pred == "und"]
    assert sorted(und.doc_id.dropna()) == [1, 2, 3, 7] and (und.score == 0).all()
    clash = labelled[0].withColumns({"lang_id": F.lit(1), "score": F.lit("x")})
    assert language_id.keep_identified(clash).columns == clash.columns


def test_false_positives_are_corrected():
    slots = np.full(8, 3, np.uint64)  # every slot is set for both languages, so a hit means nothing
    _, share = language_id.Model(["a", "b"], slots, 2).shares(["abc def"])
    assert np.allclose(share, 0)


def test_two_hundred_languages_and_ties(spark):
    """Each language has its own letters; two have the same, and the first of them wins."""
    letters = [chr(0x4E00 + 4 * i + k) for i in range(200) for k in range(4)]
    r, rows = random.Random(8), []
    for i in range(200):
        for k in range(8):
            rows.append((8 * i + k, "".join(r.choice(letters[4 * i:4 * i + 4]) for _ in range(200)), f"l{i:03d}"))
    rows += [(10_000 + d, t, "twin") for d, t, lang in rows if lang == "l000"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 201 and model.slots.shape[0] == 4
    got = docs.where("lang <> 'twin'").select("lang", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    assert len(got) == 1600 and all(x.p.lang_pred == x.lang for x in got)


def test_clashing_columns_stay(labelled):
    docs, marks = labelled
    model = toxicity.fit(docs, marks)
    names = ["_x", "_raw", "_iso", "toxicity", "_row", "_margin", "_probability", "_class", "odd.name"]
    got = model.score(docs.withColumns({n: F.lit(n) for n in names}))
    assert got.columns == [*docs.columns, *names, "toxicity_"]
    assert all(r[n] == n for r in got.collect() for n in names) and {0.0 <= r["toxicity_"] <= 1.0 for r in got.collect()} == {True}
    plain = {r.doc_id: r.toxicity for r in model.score(docs).collect()}
    assert plain == {r.doc_id: r["toxicity_"] for r in got.collect()}


def test_pieces_of_long_texts(monkeypatch):
    texts = ["Ab c", "", "éÉ" * 30, None, "x1y"]
    whole = [(int(o), int(g)) for os, gs in language_id._pieces(texts) for o, g in zip(os, gs)]
    monkeypatch.setattr(language_id, "LIMIT", 7)
    cut = [(int(o), int(g)) for os, gs in language_id._pieces(texts) for o, g in zip(os, gs)]
    assert sorted(whole) == sorted(cut) and len(whole) == 3 + 60 + 2


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["a", "b ", " ", "\n", "é", "#", "x y\n", " ", "\x0b"]) for _ in range(r.randint(0, 120)))
        assert quality_rules.base_counts(text.encode()) == brute_base(text)
    assert quality_rules.base_counts(None) == (0, 0, 0, 0, 0)


def test_quality_rules(spark, odd, none, labelled):
    docs, _ = labelled
    got = quality_rules.op10(docs.unionByName(spark.createDataFrame([(999, "zz1 9q$ " * 3 + "".join(f"{i}#x&{i * i} " for i in range(200)), "en")], docs.schema))).toPandas().set_index("doc_id")
    assert not got.loc[999].base_failed and not got.loc[999].kept
    odd_got = quality_rules.op10(odd).toPandas()
    assert len(odd_got) == 11 and odd_got[odd_got.n_words < 20].base_failed.all() and not odd_got[odd_got.base_failed].kept.any()
    assert quality_rules.op10(none).count() == 0


def test_jensen_shannon():
    p = np.array([0.5, 0.5, 0.0])
    assert np.allclose(quality_rules.js_distance(p, np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])), [0, 1])


@pytest.mark.parametrize("op, label", [(quality_classifier.op5, "quality"), (toxicity.op1, "toxic")])
def test_classifiers(spark, labelled, odd, none, op, label):
    docs, marks = labelled
    got = op(docs, marks).join(marks, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 240 and len(held) > 20 and (held.predicted == held[label]).mean() > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    wide = op(docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)), marks).toPandas()
    assert len(wide) == 251 and wide.score.notna().all()
    assert op(none, marks).count() == 0
    assert op(docs, marks.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert op(docs, marks.where(F.col(label) == 1)).select("predicted").distinct().collect()[0][0] == 1


def test_disguised_words():
    x = dict(zip(toxicity.NAMES, toxicity.features(b"you st*pid id1ot, well-known", frozenset([b"idiot", b"stupid"]))))
    assert x["disguised"] == 2 and x["near_you"] > 0
