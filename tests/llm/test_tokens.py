"""Byte-level BPE, packing and fingerprints."""
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoom.llm import bpe, fingerprints, packing

PATH, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.from_ranks(PATH), P.PATTERN)


def texts(n, seed=1):
    r = random.Random(seed)
    for i in range(n):
        if i % 3 == 0:
            yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x2FFF), r.randrange(0x1F300, 0x1F700)])) for _ in range(r.randrange(40)))
        else:
            yield "".join(r.choice(["ab", "e", "th", " ", "'", "\n", "\t  ", "s", "re", "Ü", "<|endoftext|>", "12"]) for _ in range(r.randrange(60)))


def test_encoding_equals_the_library(encoder):
    library = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    for text in texts(3000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def test_appends_and_edits_are_exact(encoder):
    r = random.Random(2)
    for text in texts(1500, 3):
        ids, more = encoder.encode(text), "".join(r.choice("abs'e \n") for _ in range(r.randrange(6)))
        a = r.randrange(len(text) + 1)
        b = r.randrange(a, len(text) + 1)
        assert encoder.append(text, ids, more) == encoder.encode(text + more)
        assert encoder.edit(text, ids, a, b, more) == encoder.encode(text[:a] + more + text[b:])


def test_prefix_table(encoder):
    v = encoder.vocabulary
    grown = bpe.Prefixes(v, b"inter").append(b"nation").append(b"al")
    assert grown.ids() == bpe.Prefixes(v, b"international").ids()
    assert grown.edit(5, 11, b"est").ids() == bpe.Prefixes(v, b"interestal").ids()


def test_long_texts_in_runs(encoder, monkeypatch):
    text = "some words, and more words; " * 500
    whole = encoder.encode(text)
    monkeypatch.setattr(bpe, "RUN", 100)
    assert encoder.encode(text) == whole


def test_round_trip(spark, odd, none):
    v = bpe.Vocabulary.from_ranks(PATH)
    got = odd.withColumn("ids", bpe.encode(spark, v, P.PATTERN, F.col("text"))).withColumn("back", bpe.decode(spark, v, F.col("ids")).cast("string"))
    assert got.where("back <> coalesce(text, '')").count() == 0
    assert got.select(F.size(bpe.unpack(F.col("ids"))).alias("n"), (F.length("ids") / 4).alias("m")).where("n <> m").count() == 0
    assert bpe.op7(none, PATH, P.PATTERN).count() == 0 and bpe.op7(odd, PATH, P.PATTERN).count() == 11


def test_plan_is_best_fit_decreasing():
    for t in range(200):
        r = random.Random(t)
        window = r.choice([8, 16, 50, 100])
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 150))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= n]
            i = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
            rooms[i:i + 1] = [(rooms[i] if fits else window) - n]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan(counts, window)
        if lengths:
            n = np.array([x for x in counts for _ in range(counts[x])])
            sequence, offset = plan.place(n, np.array([i for x in counts for i in range(counts[x])]))
            left = np.full(plan.windows, window)
            np.subtract.at(left, sequence, n)
            assert sorted(left.tolist()) == sorted(rooms)
            for s in range(plan.windows):
                at = sorted(zip(offset[sequence == s], n[sequence == s]))
                assert [a for a, _ in at] == np.cumsum([0] + [x for _, x in at])[:-1].tolist()


def test_ids_equal_the_tokenizers_library(spark):
    library = Tokenizer.from_file(JSON)
    own = packing._encoding(JSON, P.PATTERN)
    many = [*texts(1500, 9), "", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n<|endoftext", "\x00"]
    many += [t[:len(t) // 2] + "<|endoftext|>" + t[len(t) // 2:] for t in texts(300, 10)]
    assert [x.ids for x in library.encode_batch(many, add_special_tokens=False)] == [packing.encoded(own, t) for t in many]
    assert packing.encoded(own, "a<|endoftext|>b")[1] == 50256


def test_packing(spark, odd, none):
    assert packing.op3(none, JSON, P.PATTERN).count() == 0
    got = packing.pack_documents(odd.where("doc_id <> 5 and doc_id <> 6"), JSON, P.PATTERN, with_ids=True).toPandas()
    for _, doc in got.groupby(got.doc_id.fillna(-1)):
        doc = doc.sort_values("start")
        assert doc.start.tolist() == np.cumsum([0, *doc.length])[:-1].tolist() and doc.length.sum() == doc.doc_tokens.iloc[0]
        assert doc.ids.iloc[-1][-1] == 1
    for _, seq in packing.op3(odd, JSON, P.PATTERN).toPandas().groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == np.cumsum([0, *seq.length])[:-1].tolist() and seq.length.sum() <= 2048
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert set(got[got.doc_tokens == 1].doc_id) == {1, 2}


def likeness(a, b):
    import re
    cut = re.compile(r"\n+|(?<=[aeo][.!?]) ")
    a, b = ({x for x in cut.split(t) if x} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, table, odd, none):
    r = random.Random(4)
    many = [(i * 7, " ".join(r.choice(["stone. ", "tree. ", "line\n", "mud", "a", "é"]) + str(r.randrange(50)) for _ in range(r.choice([0, 1, 5, 40, 400]))), "en") for i in range(60)]
    many.append((9999, many[5][1], "en"))
    got = fingerprints.op2(table(many)).toPandas().set_index("doc_id")
    rows = sorted(many, reverse=True)
    for i, (doc_id, text, _) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited, x = text[:len(text) - k] + after[:k], got.loc[doc_id]
        assert x.near_edited == pytest.approx(likeness(text, edited)) and x.near_next == pytest.approx(likeness(text, after))
    assert got.loc[9999].fingerprint == got.loc[35].fingerprint
    assert fingerprints.op2(none).count() == 0
    wide = fingerprints.op2(odd).toPandas()
    assert len(wide) == 11 and wide.near_edited.between(0, 1).all() and wide.near_next.between(0, 1).all()
    assert fingerprints.op2(table([(1, "alone", "en")])).collect()[0]["near_next"] == 1.0
