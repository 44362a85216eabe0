"""Seeded draws that depend only on row keys, never on partitioning or row order."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hash(seed, keys, purpose) -> Column:
    """Uniform BIGINT in 0 .. 2^32-1 for (seed, keys, purpose)."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    text = F.concat_ws(":", *parts, F.lit(purpose) if isinstance(purpose, str) else purpose)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw(seed, keys, purpose, n) -> Column:
    """Uniform BIGINT in 0 .. n-1."""
    return draw_hash(seed, keys, purpose) % (F.lit(n) if isinstance(n, int) else n)


def draw_fraction(seed, keys, purpose) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return draw_hash(seed, keys, purpose) / F.lit(4294967296.0)


def draw_int(seed, keys, purpose, low, high) -> Column:
    """Uniform BIGINT in low .. high, both included."""
    return draw(seed, keys, purpose, high - low + 1) + F.lit(low)


def draw_choice(seed, keys, purpose, values) -> Column:
    """One of a short fixed list of strings."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (draw(seed, keys, purpose, len(values)) + 1).cast("int"))
