"""Fill-in-the-middle forms of documents, cut at code points that are found with SWAR words.

A text is read as UTF-8 bytes, eight to a 64-bit word. Word arithmetic marks every byte that ends a code point (the
byte after it is no continuation byte), bit counts and their running sum say how many code points end before each
word, a binary search of these sums finds the word of the n-th end, and the marks inside that word, summed by a
multiplication, give the byte. All texts of an Arrow batch are searched together, in pieces of bounded size. Only
offsets leave Python; Spark cuts and joins the bytes.

A text becomes `plain` (unchanged), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle), each part behind its
marker. Draws are the 8-digit groups of a SHA-256 of seed and doc_id, so they depend on no order or partitioning.
Texts that are empty or that hold a marker stay plain, so every output can be split at its markers again.

Null text counts as empty; a null doc_id is drawn as empty text. Repeated rows give equal rows. Very long texts: memory
is a few times the largest single text. Empty table: no rows. Other columns are kept, whatever their names.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import fresh, tidy

MARKS = ("<P>", "<S>", "<M>")
AT_ONCE = 8 << 20  # bytes searched together, or one text
LOW = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


class UnitIndex:
    """Where code points end in UTF-8 bytes; a byte position is the number of bytes before it."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)  # a zero byte after the text, which starts a unit
        padded[:len(data)] = data
        words = padded.view("<u8")
        starts = ~(words >> np.uint64(7) & ~(words >> np.uint64(6))) & LOW  # bytes other than 10xxxxxx
        after = np.append(starts[1:], LOW)
        self.ends = starts >> np.uint64(8) | after << np.uint64(56)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.ends), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte position."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        kept = self.ends[word] & ((np.uint64(1) << np.uint64(8) * inside) - np.uint64(1))
        return self.before[word] + np.bitwise_count(kept)

    def select(self, unit: np.ndarray) -> np.ndarray:
        """Byte position behind the unit with each number (from 1)."""
        word = np.searchsorted(self.before, unit, side="left") - 1
        left = (unit - self.before[word]).astype(np.uint64)
        sums = self.ends[word] * LOW  # byte i holds the ends in bytes 0..i, at most 8
        passed = ((sums | HIGH) - left * LOW) & HIGH  # bytes whose sum has reached `left`
        return word * 8 + (8 - np.bitwise_count(passed).astype(np.int64)) + 1


def cut_points(data: np.ndarray, offsets: np.ndarray, draws: list) -> tuple[np.ndarray, list, list]:
    """Units of each text (texts lie between `offsets`), and for each draw the unit and byte position `draw % (n + 1)` within its text."""
    index = UnitIndex(data)
    ranks = index.rank(offsets)
    n = np.diff(ranks)
    units = [d % (n + 1) for d in draws]
    places = []
    for u in units:
        at, moved = offsets[:-1].copy(), u > 0
        at[moved] = index.select(ranks[:-1][moved] + u[moved])
        places.append(at - offsets[:-1])
    return n, units, places


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE bytes together."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + AT_ONCE, side="right")) - 1)
        yield start, end
        start = end


def cuts(text: Column, first: Column, second: Column) -> Column:
    """struct(n, a, b in code points, p, q in bytes): the two cuts of a text in order."""
    kind = pa.struct([(x, pa.int64()) for x in ("n", "a", "b", "p", "q")])

    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint, p: bigint, q: bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            texts = texts.fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            draws, out = [x.to_numpy(zero_copy_only=False) for x in (one, two)], []
            for i, j in _groups(offsets):
                at = offsets[i:j + 1]
                n, units, places = cut_points(data[at[0]:at[-1]], at - at[0], [d[i:j] for d in draws])
                out.append(np.array([n, np.minimum(*units), np.maximum(*units), np.minimum(*places), np.maximum(*places)]))
            done = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in done], fields=list(kind))
        tidy()

    return run(text, first, second)


def draw(doc_id: str, seed: int, group: int) -> Column:
    """The group-th (from 0) 8-digit group of the SHA-256 of `seed:doc_id`, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed=1, rate=90, spm=20, marks=MARKS, text="text", doc_id="doc_id") -> DataFrame:
    """`docs` and `n`, `form`, `prefix_chars`, `middle_chars`, `output`: `rate` percent of the texts are cut, `spm` percent of these suffix first.

    Where `docs` has a column of such a name (in any case), the new one gets an underscore.
    """
    names = {}
    for x in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names[x] = fresh(docs, x)
    raw, at = fresh(docs, "_fim_text"), fresh(docs, "_fim_cuts")
    held = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    whole = (F.col(raw) == "") | F.expr(" or ".join(f"contains({raw}, '{m}')" for m in marks)) | (draw(doc_id, seed, 2) % 100 >= rate)
    form = F.when(whole, "plain").when(draw(doc_id, seed, 3) % 100 < spm, "spm").otherwise("psm")
    found = held.withColumns({at: cuts(F.col(raw), draw(doc_id, seed, 0), draw(doc_id, seed, 1)), names["form"]: form})
    part = lambda start, size: F.substring(F.col(raw).cast("binary"), start + 1, size).cast("string")  # noqa: E731  byte positions
    p, q = F.col(f"{at}.p").cast("int"), F.col(f"{at}.q").cast("int")
    prefix, middle, suffix = part(F.lit(0), p), part(p, q - p), part(q, F.lit(2**31 - 1) - q)
    mark = [F.lit(m) for m in marks]
    output = (F.when(F.col(names["form"]) == "plain", F.col(raw)).when(F.col(names["form"]) == "psm", F.concat(mark[0], prefix, mark[1], suffix, mark[2], middle))
              .otherwise(F.concat(mark[1], suffix, mark[0], prefix, mark[2], middle)))
    cut = F.col(names["form"]) != "plain"
    return found.withColumns({names["n"]: F.col(f"{at}.n"), names["prefix_chars"]: F.when(cut, F.col(f"{at}.a")),
                              names["middle_chars"]: F.when(cut, F.col(f"{at}.b") - F.col(f"{at}.a")), names["output"]: output}) \
        .select(*docs.columns, *names.values())


def restore(output: Column, form: Column, marks=MARKS) -> Column:
    """The text that `fill_in_middle` has turned into `output`."""
    tail = F.substring_index(output, marks[2], -1)  # the middle, behind the last of the three markers
    head = F.substring(output, F.lit(1), F.length(output) - F.length(tail) - len(marks[2]))
    inner = {"psm": marks[1], "spm": marks[0]}

    def parts(kind):
        left = F.substring_index(head, inner[kind], 1)
        right = F.substring(head, F.length(left) + len(inner[kind]) + 1, F.length(head))
        return F.substring(left, F.lit(len(marks[0]) + 1), F.length(left)), right

    (prefix, suffix), (last, first) = parts("psm"), parts("spm")
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, tail, suffix)).otherwise(F.concat(first, tail, last))


def op12(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs.select("doc_id", "text")).withColumn("restored", restore(F.col("output"), F.col("form")))
    digest = lambda x: F.sha2(F.col(x).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
