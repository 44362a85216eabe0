"""Document quality by Bradley-Terry pairwise ranking.

A document of the better class is preferred to one of the worse class, with probability sigmoid(f(a) - f(b)). f is a
sum over binned dense features, learned by logistic loss on the differences of pairs (no intercept, ridge). The
threshold is a quantile of the learning rows' scores, the one that separates their labels best, and the score is
sigmoid(f - threshold). Learning uses at most `max_rows` labelled rows, drawn by a hash of their id, and
`pairs_per_row` pairs for each of them, so it fits the driver whatever the corpus size.

Null and empty texts have all features zero. With one label only (or none) every score is the labels' mean (0.5
without labels). Repeated rows get equal scores.
"""
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, id_remainder
from dialoom.llm.toxicity import labelled_sample

UPPER, DIGITS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@+=_~^{}[]\\"
NAMES = ["words", "upper", "digits", "symbols", "pipes", "shouts", "stops", "commas", "word_length", "twins", "different", "equal_lines", "line_words", "sentence_words"]


def features(text: bytes | None) -> list:
    text = text or b""
    words, size = text.split(), len(text)
    if not words:
        return [0.0] * len(NAMES)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n = len(words)

    def share(chars):
        return (size - len(text.translate(None, chars))) / size

    stops = text.count(b".") + text.count(b"?")
    return [float(np.log1p(n)), share(UPPER), share(DIGITS), share(SYMBOLS), text.count(b"|") / size, text.count(b"!") / size, stops / n, text.count(b",") / n,
            size / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n ** 0.8, 1 - len(set(lines)) / len(lines), n / len(lines), n / (1 + stops)]


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t) for t in byte_texts(batch)], pa.list_(pa.float64()))

    return run(text)


class Model:
    """edges: bin edges per feature; weights: one per bin; threshold on f; or a constant."""

    def __init__(self, edges=(), weights=(), threshold=0.0, constant=None):
        self.edges, self.weights, self.threshold, self.constant = edges, weights, threshold, constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(w[np.searchsorted(e, x[:, j], side="right")] for j, (e, w) in enumerate(zip(self.edges, self.weights)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, bins=16, pairs_per_row=4, ridge=1.0, steps=12, seed=7) -> Model:
    """Newton steps on the logistic loss of preference pairs."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    first = np.cumsum([0, *sizes])
    hot = np.zeros((len(x), first[-1]), np.float32)
    for j, e in enumerate(edges):
        hot[np.arange(len(x)), first[j] + np.searchsorted(e, x[:, j], side="right")] = 1
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a = np.concatenate([np.repeat(good, pairs_per_row), draw.choice(good, len(bad) * pairs_per_row)])
    b = np.concatenate([draw.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
    w = np.zeros(first[-1])
    for _ in range(steps):
        gradient, curve = ridge * w, np.eye(len(w)) * ridge
        for s in range(0, len(a), 20_000):  # pairs are formed block by block
            d = hot[a[s:s + 20_000]] - hot[b[s:s + 20_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = gradient - d.T @ (1 - p)
            curve += (d * (p * (1 - p))[:, None]).T @ d
        w = w - np.linalg.solve(curve, gradient)
    model = Model(edges, [w[first[j]:first[j + 1]] for j in range(len(sizes))])
    raw = model.raw(x)
    cuts = np.unique(np.quantile(raw, np.linspace(0.005, 0.995, 199)))
    rights = [((raw >= t) == (y == 1)).mean() for t in cuts]
    best = np.flatnonzero(np.isclose(rights, max(rights)))
    model.threshold = float(cuts[best[len(best) // 2]])
    return model


def fit(docs: DataFrame, labels: DataFrame, label="quality", max_rows=20_000) -> Model:
    sample = labelled_sample(docs, labels, label, max_rows).select("doc_id", "y", feature_column(F.col("text")).alias("x")).toArrow().sort_by([("doc_id", "ascending")])
    y = sample.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    return fit_pairs(np.array(sample.column("x").to_pylist()), y)


def score_column(spark, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([features(t) for t in byte_texts(batch)]).reshape(-1, len(NAMES))
            yield pa.array(shared.value.score(x), pa.float64())

    return run(text)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(id_remainder("doc_id", 3) != 1))
    scored = docs.select("doc_id", score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
