"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds one bit per language, in as many 64-bit words as the languages
need (the filters of all languages, bit-sliced). Looking up an n-gram ANDs its slots, which gives the set of
languages that contain it at once. A document counts, per language, how many of its letters stand in the middle of a contained
trigram; the count is corrected for the filter's false positives, and the highest corrected share wins.

Trigrams are of lower-cased letters, and everything else counts as one blank, so each letter of a text is
the middle of exactly one trigram, also at word ends and in words of one letter.

Null text, or text without a letter: `und`, score 0. Rows with a null language teach nothing. Nothing to
learn from (no labelled rows, an empty table): every prediction is `und`. Equal shares: the language that
comes first in the alphabet. Repeated rows get the same result.
"""
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import fresh, id_remainder, mix, tidy

LIMIT = 1 << 18  # characters handled at once inside a task


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for all that isn't a letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def _pieces(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, trigram) for every letter, some LIMIT characters at a time; texts of any length are cut."""
    held, size = [], 0

    def flush():
        lens = np.fromiter((len(p) for _, p in held), np.int64, len(held))
        x = _letters()[np.frombuffer("".join(p for _, p in held).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        owner = np.repeat(np.fromiter((i for i, _ in held), np.int64, len(held)), lens)
        middle = x != 0
        ends = np.cumsum(lens)
        middle[ends - 1] = middle[ends - lens] = False  # these two are context only
        at = np.flatnonzero(middle)
        return owner[at], (x[at - 1] << np.uint64(42)) | (x[at] << np.uint64(21)) | x[at + 1]

    for i, text in enumerate(texts):
        for s in range(0, len(text or ""), LIMIT):
            held.append((i, (text[s - 1] if s else "\0") + text[s:s + LIMIT] + (text[s + LIMIT:s + LIMIT + 1] or "\0")))
            size += len(held[-1][1])
            if size >= LIMIT:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all rows with a language. Each task adds up its batches before anything is shuffled."""
    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            out = {}
            for owner, gram in _pieces(texts):
                for l in set(langs[np.unique(owner)]):
                    keys, n = np.unique(gram[langs[owner] == l], return_counts=True)
                    out.setdefault(l, []).append((keys, n))
            for l, parts in out.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.record_batch([pa.array([l] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        tidy()

    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return seen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """langs: sorted languages; slots: the bit-sliced filter, a row of slots for each 64 languages; wrong: false-positive rate per language."""

    def __init__(self, langs, slots, hashes):
        self.langs, self.slots, self.hashes = langs, np.atleast_2d(slots), hashes
        bits = [float(np.mean((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))]
        self.wrong = np.array([b ** hashes for b in bits])

    def masks(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        """The languages that contain each trigram, as bits, 64 languages at a time."""
        at = [(mix(gram, j + 1) & np.uint64(self.slots.shape[1] - 1)).astype(np.int64) for j in range(self.hashes)]
        for word in self.slots:
            yield functools.reduce(np.bitwise_and, (word[a] for a in at))

    def shares(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and the corrected share per language."""
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for owner, gram in _pieces(texts):
            n += np.bincount(owner, minlength=len(texts))
            for w, mask in enumerate(self.masks(gram)):
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    hits[:, i] += np.bincount(owner[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
        share = hits / np.maximum(n, 1)[:, None]
        return n, np.clip((share - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0, 1)


def fit(docs: DataFrame, text="text", lang="lang", min_share=1e-5, contrast=0.1, bits=18, hashes=3) -> Model:
    """Learn the filter from all rows of `docs` that have a language.

    A trigram enters a language's filter if it makes up at least `min_share` of that language's trigrams and
    at least `contrast` of its highest share in any language (else stray foreign words would enter). So the
    driver receives at most 1/min_share trigrams per language, whatever the input's size, and the filter has
    2**bits slots of one bit per language, rounded up to whole words: 2 MB for each 64 languages.
    """
    counts = trigram_counts(docs, text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    best = share.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("in"), F.max("share").alias("top"))
    kept = best.select("gram", F.expr(f"transform(filter(in, x -> x.share >= {contrast} * top), x -> x.lang)").alias("langs")).toArrow()
    langs = sorted({x for xs in kept.column("langs").to_pylist() for x in xs})
    slots = np.zeros((-(-len(langs) // 64), 1 << bits), dtype=np.uint64)
    grams = kept.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    place = {lang: i for i, lang in enumerate(langs)}
    sets = [sum(1 << place[x] for x in xs) for xs in kept.column("langs").to_pylist()]
    for w, word in enumerate(slots):
        mask = np.array([(x >> 64 * w) & 0xFFFFFFFFFFFFFFFF for x in sets], dtype=np.uint64)
        for j in range(hashes):
            np.bitwise_or.at(word, (mix(grams, j + 1) & np.uint64(word.size - 1)).astype(np.int64), mask)
    return Model(langs, slots, hashes)


def predict(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, coverage): score is the winner's part of the two best shares, coverage its own share."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, coverage: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            n, share = m.shares(batch.to_pylist())
            share = np.concatenate([share, np.zeros((len(share), max(0, 2 - share.shape[1])))], axis=1)
            order = np.argsort(-share, axis=1, kind="stable")
            rows = np.arange(len(share))
            top, second = share[rows, order[:, 0]], share[rows, order[:, 1]]
            known = (n > 0) & (len(m.langs) > 0)
            score = np.where(known, top / np.maximum(top + second, 1e-12), 0.0)
            names = [m.langs[i] if k else "und" for i, k in zip(np.minimum(order[:, 0], max(0, len(m.langs) - 1)), known)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.where(known, top, 0.0))],
                                             names=["lang_pred", "score", "coverage"])
        tidy()

    return run(text)


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """All columns of `docs` plus lang_id (struct lang_pred, score, coverage); learns from the rows where `learn_from` holds."""
    return docs.withColumn(fresh(docs, "lang_id"), predict(docs.sparkSession, fit(docs.where(learn_from)), F.col("text")))


def keep_identified(docs: DataFrame, min_coverage=0.2) -> DataFrame:
    """Documents in a known language: not `und`, and the winner contains at least `min_coverage` of the trigrams."""
    name = fresh(docs, "lang_id")
    found = identify(docs, F.lit(True))
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["coverage"] >= min_coverage)).drop(name)


def op9(docs: DataFrame) -> DataFrame:
    held = id_remainder("doc_id", 4) == 2
    found = identify(docs.select("doc_id", "text", "lang"), ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_id.lang_pred", "lang_id.score", "lang_id.coverage")
