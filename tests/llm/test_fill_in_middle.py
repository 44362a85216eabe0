"""Fill-in-the-middle: cuts, forms and exact way back, against plain string work."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import fill_in_middle as fim

UNITS = ["a", "é", "本", "🙂", "\n", "<", "<P", ">", "\x00", "é", "x" * 9, "", "M>", "<<S"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(UNITS) for _ in range(r.choice([0, 1, 2, 7, 8, 9, 40, 300]))) for _ in range(n)]


def slow(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_rank_and_select():
    for t in texts(200, 1):
        data = np.frombuffer(t.encode(), np.uint8)
        index = fim.UnitIndex(data)
        ends = np.cumsum([len(c.encode()) for c in t]).astype(np.int64)
        assert index.select(np.arange(1, len(t) + 1)).tolist() == ends.tolist()
        at = np.arange(len(data) + 1)
        assert index.rank(at).tolist() == [int((ends <= x).sum()) for x in at]


def test_cut_points_of_a_batch(monkeypatch):
    many = texts(300, 2)
    data = "".join(many).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in many)])
    draws = [np.random.default_rng(s).integers(0, 2**32, len(many)) for s in (1, 2)]
    n, units, places = fim.cut_points(np.frombuffer(data, np.uint8), offsets, draws)
    assert n.tolist() == [len(t) for t in many]
    for d, u, p in zip(draws, units, places):
        assert u.tolist() == [int(x) % (len(t) + 1) for x, t in zip(d, many)]
        assert p.tolist() == [len(t[:k].encode()) for t, k in zip(many, u)]
    monkeypatch.setattr(fim, "AT_ONCE", 50)
    ranges = list(fim._groups(offsets))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(many) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])) and len(ranges) > 20


@pytest.mark.parametrize("at_once", [fim.AT_ONCE, 64])
def test_forms_equal_plain_strings(table, at_once, monkeypatch):
    monkeypatch.setattr(fim, "AT_ONCE", at_once)
    rows = [(i, t, "en") for i, t in enumerate(texts(500, 3))] + [(10**9, None, "en"), (None, "no id", "en"), (7, "twice", "en"), (7, "twice", "en"), (8, "has <M> inside", "en")]
    got = fim.fill_in_middle(table(rows)).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()))) == sorted(repr((i, *slow(i, t))) for i, t, _ in rows)
    assert got.where("restored <> coalesce(text, '')").count() == 0
    assert {r[0] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_odd(odd, none):
    got = fim.op12(odd).toPandas()
    assert len(got) == 11 and fim.op12(none).count() == 0
    assert set(got[got.n == 0].form) == {"plain"} and got[got.form == "plain"].prefix_chars.isna().all()
    clash = odd.withColumns({"n": F.lit("x"), "Form": F.lit(1), "_fim_text": F.lit(2), "output": F.lit(None).cast("string")})
    wide = fim.fill_in_middle(clash)
    assert wide.columns[:len(clash.columns)] == clash.columns and len(wide.columns) == len(clash.columns) + 5
    assert wide.where("n_ <> coalesce(length(text), 0) or n <> 'x' or `_fim_text` <> 2").count() == 0
