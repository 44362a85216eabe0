"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For each prefix of a piece the table `last` stores the one token that ends the encoding of that prefix. A token
ending at a byte is right if and only if merging would never join or cut across its border with the last token of
the prefix before it, which `Vocabulary.fits` decides by undoing merges on both sides. So a piece is encoded in
linear time, appending bytes only extends the table, and an edit recomputes it from the edited byte on.

A text is first cut by the split pattern; a piece that is itself a token gets that token, as in the usual
encoders. Ids travel packed, as little-endian unsigned 32-bit integers in one binary value per text.

Null text: no ids (and decodes to no bytes). Texts of any length are handled in runs of matches, with bounded
working memory besides the text and its ids. Rows and other columns are untouched.
"""
import base64
import functools
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import tidy

CACHE, CACHED_BYTES, PAIRS, RUN = 120_000, 48, 300_000, 100_000


def pack_ids(ids: list) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Vocabulary:
    """Tokens by rank. `split` undoes a token's last merge, `pair` does it; `parts` holds the tokens that merging can reach."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.longest = max(self.sizes)
        self.pair: dict = {}
        self.split = [(i, i) for i in range(len(self.tokens))]
        self.parts: dict = {}
        self.known: dict = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.parts.get(token[:cut]), self.parts.get(token[cut:])
                if a is not None and b is not None and self._fits(a, b):
                    self.pair[a, b] = rank
                    self.split[rank] = (a, b)
                    self.parts[token] = rank
                    break
        self.known.clear()

    @functools.cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all tokens in a text, read as Latin-1; at each end the longest first."""
        automaton = ahocorasick.Automaton()
        for token, rank in self.parts.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        return automaton

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"} | {"known": {}}

    @staticmethod
    def from_ranks(path: str) -> "Vocabulary":
        """Read lines of `base64 rank`."""
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Merges happen in the order of their ranks. Undo the younger merge of the two border tokens, again and again;
        a merge across the border that is older than what was undone would have come first.
        """
        limit = len(self.tokens)
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            inner_a, inner_b = self.split[a][1], self.split[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                limit, a = a, inner_a
            else:
                limit, b = b + 1, inner_b  # of two equal ranks the left one is merged first

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            known = self.known[key] = self._fits(a, b)
        return known


class Prefixes:
    """The table of a growing or edited piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> "Prefixes":
        v, last, begin = self.vocabulary, self.last, len(self.last)
        self.data += more
        known, fits = v.known.get, v.fits
        for end, (token, size) in v.finder.iter(self.data.decode("latin-1"), max(0, begin - v.longest)):
            end += 1
            if end == len(last):  # neither an old prefix nor one whose token is found
                start = end - size
                if start == 0:
                    last.append(token)
                else:
                    good = known(last[start] << 32 | token)
                    if good or good is None and fits(last[start], token):
                        last.append(token)
        if len(last) != len(self.data) + 1:
            raise ValueError("the vocabulary lacks a byte")
        return self

    def edit(self, start: int, end: int, new: bytes) -> "Prefixes":
        """Replace data[start:end]; prefixes up to `start` keep their tokens."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start + 1]
        return self.append(new + rest)

    def ids(self) -> list:
        out, end, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


class Encoder(dict):
    """Piece -> packed ids. Remembers short pieces; when CACHE of them are held, those not used since the last time go."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.pattern, self.older = vocabulary, regex.compile(pattern), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            whole = self.vocabulary.ranks.get(data)
            ids = pack_ids([whole] if whole is not None else Prefixes(self.vocabulary, data).ids())
            if len(data) > CACHED_BYTES:
                return ids
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str, start=0) -> bytes:
        if len(text) - start <= RUN:
            return b"".join(map(self.__getitem__, self.pattern.findall(text, start)))
        matches, out = self.pattern.finditer(text, start), []
        while run := b"".join(self[m[0]] for m in islice(matches, RUN)):
            out.append(run)
        return b"".join(out)

    def append(self, text: str, ids: bytes, more: str) -> bytes:
        """Ids of text + more, given those of `text`. Only the last pieces can change: an apostrophe and a letter before
        the end may become one ending, and blanks at the end may go to the next word."""
        return self.edit(text, ids, len(text), len(text), more)

    def edit(self, text: str, ids: bytes, start: int, end: int, new: str) -> bytes:
        """Ids after text[start:end] became `new`: pieces well before the edit keep theirs, and so do those from the
        first place where old and new pieces begin at the same character again."""
        spans = [m.span() for m in self.pattern.finditer(text)]
        first = max(0, next((i for i, s in enumerate(spans) if s[1] >= start), len(spans)) - 3)
        begin = spans[first][0] if spans else 0
        changed, shift = text[:start] + new + text[end:], len(new) - (end - start)
        olds = {s[0] + shift: i for i, s in enumerate(spans) if s[0] >= end}
        fresh, back = [], None
        for m in self.pattern.finditer(changed, begin):
            if m.start() in olds:
                back = olds[m.start()]
                break
            fresh.append(self[m[0]])
        old_middle = sum(len(self[text[a:b]]) for a, b in spans[first:back])
        before = sum(len(self[text[a:b]]) for a, b in spans[:first])
        return ids[:before] + b"".join(fresh) + ids[before + old_middle:]


def encode(spark, vocabulary: Vocabulary, pattern: str, text: Column) -> Column:
    """Packed ids of each text. The vocabulary, whose size is fixed, goes to every executor."""
    shared = spark.sparkContext.broadcast((vocabulary, pattern))

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            yield pa.array([encoder.encode(t.as_py() or "") for t in batch], pa.binary())
        encoder.clear()
        encoder.older.clear()
        tidy()

    return run(text)


def decode(spark, vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes that packed ids stand for."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            yield pa.array([b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch], pa.binary())
        tidy()

    return run(ids)


def unpack(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    @F.arrow_udf("array<bigint>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.to_pylist()], pa.list_(pa.int64()))

    return run(ids)


def op7(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    spark, vocabulary = docs.sparkSession, Vocabulary.from_ranks(path)
    ids = docs.select("doc_id", encode(spark, vocabulary, pattern, F.col("text")).alias("ids"))
    return ids.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(decode(spark, vocabulary, F.col("ids")), 256).alias("decoded_sha256"))
