"""Quality rules: base rules on words and repetition, then the divergence from language references.

Words are runs of anything but space and tab to carriage return. Base: code points in words; symbols
``#*$%&|<>``; lines with a word that equal an earlier line; words inside 8-word windows found twice or more.
A text fails the base with fewer than 20 words or with over 30 % repeated words.

The rest compares two histograms of the text with references of each language: classes of characters
(lower, upper, digit, blank, sentence marks, symbols, other marks, beyond ASCII) and the language's most
common words (all others are one more bin). The distance is Jensen-Shannon's, the square root of the
divergence in bits, 0 to 1. The language with the smallest sum of both counts, so a missing or wrong
language label doesn't matter. A text fails if either distance is above its limit; texts below a minimum
length are not judged by that histogram, because a few words are always far from any reference.

Null text has no words. Without references (an empty table, no languages) only the base rules decide.
"""
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, fresh

WINDOW, SYMBOLS = 8, b"#*$%&|<>"
MARKS = b".,;:!?'\"()-"
CLASSES = ["lower", "upper", "digit", "blank", "mark", "symbol", "other", "beyond"]
CLASS_OF = np.full(256, 6, np.int64)
for _c in range(256):
    _b = bytes([_c])
    CLASS_OF[_c] = (7 if _c >= 128 else 0 if _b.islower() else 1 if _b.isupper() else 2 if _b.isdigit() else 3 if _b.isspace()
                    else 4 if _b in MARKS else 5 if _b in SYMBOLS else 6)
BLANKED = bytes.maketrans(MARKS, b" " * len(MARKS))
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list) -> int:
    """Words covered by 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = [tuple(words[i:i + WINDOW]) for i in maybe.tolist()]  # equal hashes are confirmed on the words themselves
    times = Counter(windows)
    starts = maybe[[times[w] > 1 for w in windows]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text) - len(text.translate(None, bytes(range(128, 192)))) if not text.isascii() else 0  # continuation bytes
    word_chars = len(text) - chars - (len(text) - sum(map(len, words)))
    return len(words), word_chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def plain_words(text: bytes) -> list:
    """Lower-cased (A-Z) words without sentence marks."""
    return text.translate(BLANKED).lower().split()


class References:
    def __init__(self, langs, chars, vocab, words):
        """chars: langs x classes; vocab: word -> column; words: langs x vocab shares."""
        self.langs, self.chars, self.vocab, self.words = langs, chars, vocab, words


def fit(docs: DataFrame, text="text", lang="lang", top=100) -> References:
    """Histograms of every language over all its documents; the driver gets the `top` words of each only."""
    def count(batches):
        for batch in batches:
            chars, words = {}, {}
            for t, l in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                chars[l] = chars.get(l, 0) + np.bincount(CLASS_OF[np.frombuffer(t, np.uint8)], minlength=len(CLASSES))
                words.setdefault(l, Counter()).update(plain_words(t))
            rows = [(l, i, None, int(n)) for l, c in chars.items() for i, n in enumerate(c)]
            rows += [(l, None, w, n) for l, c in words.items() for w, n in c.items()]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.int64()))], names=["lang", "class", "word", "n"])

    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = seen.mapInArrow(count, "lang string, class int, word binary, n bigint").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    kind = F.col("class").isNotNull()
    totals = {(r["lang"], r["chars"]): r["total"] for r in counts.groupBy("lang", kind.alias("chars")).agg(F.sum("n").alias("total")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang", kind).orderBy(F.desc("n"), "word", "class"))  # as a limit it is taken before the shuffle
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= max(top, len(CLASSES))).orderBy("lang", "rank").collect()
    langs = sorted({r["lang"] for r in ranked})
    vocab: dict = {}
    for r in ranked:
        if r["word"] is not None and r["rank"] <= top:
            vocab.setdefault(bytes(r["word"]), len(vocab))
    chars, words = np.zeros((len(langs), len(CLASSES))), np.zeros((len(langs), len(vocab)))
    for r in ranked:
        share = r["n"] / max(1, totals[r["lang"], r["class"] is not None])
        if r["class"] is not None:
            chars[langs.index(r["lang"]), r["class"]] = share
        elif r["rank"] <= top:
            words[langs.index(r["lang"]), vocab[bytes(r["word"])]] = share
    return References(langs, chars, vocab, words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the histogram p to each row of q."""
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.sqrt(np.clip((kl(np.broadcast_to(p, q.shape)) + kl(q)) / 2, 0, 1))


def judge(spark, refs: References, text: Column, min_words=80, min_chars=300, char_limit=0.30, word_limit=0.50) -> Column:
    """struct of the base counts, base_failed, char_distance and word_distance (null if too short), and kept."""
    shared = spark.sparkContext.broadcast(refs)

    @F.arrow_udf(f"struct<{BASE}, base_failed boolean, char_distance double, word_distance double, kept boolean>".replace(" bigint", ": bigint").replace(" boolean", ": boolean").replace(" double", ": double"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        r = shared.value
        inside = [np.flatnonzero(row) for row in r.words]
        for batch in batches:
            rows = []
            for t in byte_texts(batch):
                counts = base_counts(t)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                by_char = by_word = None
                if r.langs and len(t or b"") >= min_chars:
                    c = np.bincount(CLASS_OF[np.frombuffer(t, np.uint8)], minlength=len(CLASSES))
                    by_char = js_distance(c / c.sum(), r.chars)
                words = plain_words(t) if r.langs and counts[0] >= min_words else []
                if len(words) >= min_words:
                    c = np.bincount(np.fromiter(map(r.vocab.get, words, repeat(len(r.vocab))), np.int64, len(words)), minlength=len(r.vocab) + 1)
                    by_word = np.empty(len(r.langs))
                    for i, at in enumerate(inside):
                        p, q = c[at] / len(words), r.words[i, at]
                        by_word[i] = js_distance(np.append(p, 1 - p.sum()), np.append(q, max(0, 1 - q.sum()))[None, :])[0]
                best = 0 if by_char is None and by_word is None else int(np.argmin((0 if by_char is None else by_char) + (0 if by_word is None else by_word)))
                far_char, far_word = (None if x is None else float(x[best]) for x in (by_char, by_word))
                rows.append((*counts, failed, far_char, far_word, not failed and (far_char or 0) <= char_limit and (far_word or 0) <= word_limit))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"])

    return run(text)


def with_verdict(docs: DataFrame) -> DataFrame:
    """All columns of `docs` plus quality_rules; references come from all rows that have a language."""
    return docs.withColumn(fresh(docs, "quality_rules"), judge(docs.sparkSession, fit(docs), F.col("text")))


def op10(docs: DataFrame) -> DataFrame:
    found = with_verdict(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", *[F.col(f"quality_rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
