"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (given words and words learned from the labels), lexicon words near a second
person, and rates of capitals, exclamation marks, other punctuation and obfuscated words. Learning uses at most
`max_rows` labelled rows, drawn by a hash of their id; the trees are pyspark.ml's. Two forests, each fitted on one
half, score the other half; isotonic regression on those scores calibrates the forest fitted on all.

Null and empty texts have all features zero and get the score of such texts. With one label only (or none) every
score is the labels' mean (0.5 without labels). Labels that are null or whose document is missing teach nothing.
Repeated rows, and texts with equal features, get equal scores; several labels for one document all count. Very long texts
are read as a whole, one at a time.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, fresh, id_remainder, stage

# Insults and second-person words of four languages, in lower case.
INSULTS = """idiot stupid moron dumb fool loser scum trash garbage pathetic worthless disgusting clown jerk bastard
dumm dummkopf trottel arschloch abschaum versager widerlich erbärmlich wertlos
imbécile crétin abruti ordure minable pathétique connard débile
estúpido imbécil tonto basura asqueroso patético inútil escoria""".split()
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine deinen ihr euch euer
tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros tus""".split()
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
INSIDE = b"*_~^+"
MARKS = b".,;:?\"()-'"
BLANKED = bytes.maketrans(MARKS, b" " * len(MARKS))
YOU = frozenset(x.encode() for x in SECOND_PERSON)
NEAR = 5
NAMES = ["density", "hits", "different", "near_you", "capitals", "shouts", "marks", "symbols", "mixed", "disguised", "length"]


def plain(word: bytes) -> bytes:
    """A word without disguise: digits and signs read as letters, signs inside dropped."""
    return word.translate(LEET, INSIDE)


def bones(word: bytes) -> bytes:
    """First letter and consonants: what is left of a word whose vowels are starred out."""
    word = plain(word)
    return word[:1] + word[1:].translate(None, b"aeiou")


def features(text: bytes | None, lexicon: frozenset) -> list:
    text = text or b""
    words = text.translate(BLANKED).lower().split()
    if not words:
        return [0.0] * len(NAMES)
    own = {w.strip(b"!") for w in set(words)}
    odd = {w for w in own if w.translate(LEET, INSIDE) != w}
    disguised = {w for w in odd if w not in lexicon and (plain(w) in lexicon or (len(w) > 4 and w != w.translate(None, INSIDE) and bones(w) in {bones(x) for x in lexicon if len(x) == len(w)}))}
    known = (own & lexicon) | disguised
    at = [i for i, w in enumerate(words) if w.strip(b"!") in known] if known else []
    near = sum(1 for i in at if not YOU.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]))
    n, size = len(words), len(text)
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [len(at) / n, float(np.log1p(len(at))), float(len(known)), near / n, upper / size, text.count(b"!") / size,
            (size - len(text.translate(None, MARKS))) / size, (size - len(text.translate(None, b"#*$%&|<>@"))) / size, len(odd) / n,
            float(len(disguised)), float(np.log1p(n))]


def feature_column(spark, lexicon: frozenset, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t, shared.value) for t in byte_texts(batch)], pa.list_(pa.float64()))

    return run(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text, y of at most `max_rows` labelled documents, staged. The bound on the labels makes their broadcast safe."""
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", (F.col(label) > 0).cast("double").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    return stage(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y"))


def learned_words(sample: DataFrame, most=300, min_share=0.01, min_odds=20.0) -> list:
    """Words in at least `min_share` of the positive documents and at least `min_odds` times likelier there; at most `most`."""
    def count(batches):
        for batch in batches:
            seen: dict = {}
            for text, y in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                for w in set((text or b"").translate(BLANKED).lower().split()):
                    row = seen.setdefault(w.strip(b"!"), [0, 0])
                    row[int(y)] += 1
            yield pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array([r[0] for r in seen.values()], pa.int64()), pa.array([r[1] for r in seen.values()], pa.int64())],
                                  names=["word", "no", "yes"])

    total = sample.agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).first()
    yes, no = total["yes"] or 0, total["no"] or 0
    words = sample.select("text", "y").mapInArrow(count, "word binary, no bigint, yes bigint").groupBy("word").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    odds = ((F.col("yes") + 0.5) / (yes + 1)) / ((F.col("no") + 0.5) / (no + 1))
    return [bytes(r["word"]) for r in words.where((F.col("yes") >= max(3.0, min_share * yes)) & (odds >= min_odds)).orderBy(F.desc(odds), "word").limit(most).collect()]


class Model:
    """lexicon, a forest and the isotonic map; or `constant` if the labels don't differ."""

    def __init__(self, lexicon, forest=None, isotonic=None, constant=None):
        self.lexicon, self.forest, self.isotonic, self.constant = lexicon, forest, isotonic, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of `docs` plus toxicity (0 to 1), whatever they are called; where `docs` has that name, with `_` added."""
        name = fresh(docs, "toxicity")
        if self.constant is not None:
            return docs.withColumn(name, F.lit(float(self.constant)))
        # the caller's columns travel in one struct, so that none meets those of the models
        made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), array_to_vector(feature_column(docs.sparkSession, self.lexicon, F.col("text"))).alias("_x"))
        found = self.isotonic.transform(_scored(self.forest, made))
        return found.select("_row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_iso")).alias(name))


def _scored(forest, df: DataFrame) -> DataFrame:
    kept = df.columns
    return forest.transform(df).select(*kept, vector_to_array("_probability")[1].alias("_raw"))


def fit(docs: DataFrame, labels: DataFrame, label="toxic", max_rows=20_000, trees=20, depth=3) -> Model:
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, max_rows)
    mean = sample.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    if mean[0] is None or mean[1] == mean[2]:
        return Model(frozenset(), constant=0.5 if mean[0] is None else mean[0])
    lexicon = frozenset(x.encode() for x in INSULTS) | frozenset(learned_words(sample)) - {b""}
    made = stage(sample.select("y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"), feature_column(spark, lexicon, F.col("text")).alias("x"))
                 .repartition(4, F.xxhash64("x")))
    made = made.select("y", "half", array_to_vector("x").alias("_x"))
    trainer = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, predictionCol="_class")
    trainer.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    held = []
    for half in (0, 1):
        rest = made.where(F.col("half") != half)
        if rest.select("y").distinct().count() == 2:
            held.append(_scored(trainer.fit(rest), made.where(F.col("half") == half)).select("y", "_raw"))
    forest = trainer.fit(made)
    scores = held[0].union(held[1]) if len(held) == 2 else _scored(forest, made).select("y", "_raw")
    isotonic = IsotonicRegression(featuresCol="_raw", labelCol="y", predictionCol="_iso").fit(scores)
    return Model(lexicon, forest, isotonic)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
