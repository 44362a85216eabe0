"""Running sums and neighbouring values over ordered groups, by one range partitioning and one local pass.

A plain window sends a whole group to one task, so a key with a third of all rows, or a single key, runs alone. Here the
rows are dealt out by ranges of (keys, order), whatever their values: a large group spreads over as many tasks as it
fills. Each task walks through its sorted rows once. What a group brings along from the partitions before is worked out
from two small rows per partition, its first and its last, and added when the staged result is read.

The input is read for one exchange (Spark also samples its keys for the borders). `order` has to decide between the
rows of a key: rows that are equal in keys and order share a partition, and take their numbers in any order.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.stage import stage

PREFIX = "_scan_"


def _same(column: pa.Array, earlier: pa.Array) -> np.ndarray:
    """Where two columns agree; nulls agree with nulls."""
    equal = pc.fill_null(pc.equal(column, earlier), False)
    return pc.or_(equal, pc.and_(pc.is_null(column), pc.is_null(earlier))).to_numpy(zero_copy_only=False)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each batch with rows, the last row before it and the first row behind it."""
    before = now = None
    for batch in batches:
        if batch.num_rows:
            if now is not None:
                yield before, now, batch.slice(0, 1)
                before = now.slice(now.num_rows - 1, 1)
            now = batch
    if now is not None:
        yield before, now, None


def _shifted(values: pa.Array, same: np.ndarray, outside: pa.Array | None, forward: bool) -> pa.Array:
    """Each row's neighbour, null where the neighbour has another key; `outside` is the neighbour beyond the batch."""
    edge = outside if outside is not None else pa.nulls(1, values.type)
    moved = pa.concat_arrays([values.slice(1), edge] if forward else [edge, values.slice(0, len(values) - 1)])
    return pc.if_else(pa.array(same), moved, pa.nulls(len(values), values.type))


class _Walk:
    """The local pass over one partition; keys, sums, back, ahead and gaps (with limits) are columns of the batches, by number."""

    def __init__(self, keys: list, sums: list, back: list, ahead: list, gaps: list):
        self.keys, self.sums, self.back, self.ahead, self.gaps = keys, sums, back, ahead, gaps

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        carried, head, first = np.zeros(len(self.sums) + len(self.gaps), np.int64), True, True
        for before, batch, after in _with_next(batches):
            n = batch.num_rows
            same = np.ones(n, bool)
            same[0] = before is not None
            for k in self.keys:
                c = batch.column(k)
                same[1:] &= _same(c.slice(1), c.slice(0, n - 1))
                if before is not None:
                    same[0] &= _same(c.slice(0, 1), before.column(k))[0]
            start = np.maximum.accumulate(np.where(same, -1, np.arange(n)))  # -1: the group began in an earlier batch
            steps = [batch.column(s).fill_null(0).to_numpy(zero_copy_only=False) for s in self.sums]
            for g, limit in self.gaps:
                gap = pc.subtract(batch.column(g), _shifted(batch.column(g), same, before and before.column(g), False))
                steps.append(pc.fill_null(pc.greater_equal(gap, limit), True).cast(pa.int64()).to_numpy(zero_copy_only=False))
            sums = []
            for i, step in enumerate(steps):
                total = np.cumsum(step)
                sums.append(total - np.where(start < 0, -carried[i], np.where(start > 0, total[np.maximum(start, 1) - 1], 0)))
                carried[i] = sums[i][-1]
            follows = np.append(same[1:], after is not None and all(_same(after.column(k), batch.column(k).slice(n - 1, 1))[0] for k in self.keys))
            at_head = head & (start <= 0) if first else head & (start < 0)
            head = bool(at_head[-1])
            edge = np.zeros(n, np.int8)
            edge[0] += first
            edge[-1] += 2 * (after is None)
            first = False
            made = [pa.array(x, pa.int64()) for x in sums]
            made += [_shifted(batch.column(v), same, before and before.column(v), False) for v in self.back]
            made += [_shifted(batch.column(v), follows, after and after.column(v), True) for v in self.ahead]
            made += [pa.array(np.full(n, partition), pa.int32()), pa.array(at_head), pa.array(edge, pa.int8())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[str(i) for i in range(batch.num_columns + len(made))])


def scan(df: DataFrame, keys, order, sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
         following: dict[str, Column] | None = None, gaps: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """`df` and, per `keys` in `order`: running `sums` (inclusive, bigint), the values of the row before or after (null at a group's ends),
    and for `gaps` the number of stretches so far: one begins where a value is `limit` or more above the one before, or either is null.

    Keys are column names; null is a key like others. Null values add nothing to a sum. New columns replace equally
    named ones. Names that start with `_scan_` are the helper's own. No rows: an empty result.
    """
    keys, sums, previous, following, gaps = list(keys), sums or {}, previous or {}, following or {}, gaps or {}
    named = lambda kind, cols: {f"{PREFIX}{kind}{i}": c for i, c in enumerate(cols.values())}
    s, b, a = named("s", sums), named("b", previous), named("a", following)
    g = named("g", {n: v for n, (v, _) in gaps.items()})
    limits = dict(zip(g, [limit for _, limit in gaps.values()]))
    base = df.withColumns({x: c.cast("bigint") for x, c in (s | g).items()} | b | a)
    dealt = base.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    schema = T.StructType(list(base.schema.fields))
    local = [f"{x}_local" for x in [*s, *g, *b, *a]]
    for x, kept in zip([*s, *g, *b, *a], local):
        schema = schema.add(kept, base.schema[x].dataType)
    schema = schema.add(PREFIX + "pid", T.IntegerType()).add(PREFIX + "head", T.BooleanType()).add(PREFIX + "edge", T.ByteType())
    for field in schema.fields:
        field.nullable = True
    at = {c: i for i, c in enumerate(base.columns)}
    walk = _Walk([at[k] for k in keys], [at[x] for x in s], [at[x] for x in b], [at[x] for x in a], [(at[x], limits[x]) for x in g])
    walked = stage(dealt.mapInArrow(walk, schema))

    # Of each partition the first and the last row, in order; a partition of one row gives both.
    pid, edge, side = PREFIX + "pid", PREFIX + "edge", PREFIX + "side"
    ends = walked.where(F.col(edge) > 0).select(*keys, pid, *[f"{x}_local" for x in [*s, *g]], *g, *b, *a, F.explode(F.when(F.col(edge) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col(edge).cast("int")))).alias(side))
    along = Window.partitionBy(*keys).orderBy(pid, side)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"{x}_carry": F.sum(F.when(F.col(side) == 2, F.col(f"{x}_local"))).over(before) for x in s}
    for x in g:  # a partition's first row counts as a beginning there; where it isn't, one is taken off for the rows of its group
        linked = F.coalesce(F.col(x) - F.lag(x).over(along) < limits[x], F.lit(False)) & (F.col(side) == 1)
        ends = ends.withColumn(f"{x}_off", F.when(linked, 1).otherwise(0))
        counted = F.when(F.col(side) == 2, F.col(f"{x}_local")).otherwise(-F.col(f"{x}_off"))
        carry[f"{x}_carry"] = F.sum(counted).over(along.rowsBetween(Window.unboundedPreceding, 0))
    carry |= {f"{x}_carry": F.lag(x).over(along) for x in b} | {f"{x}_carry": F.lead(x).over(along) for x in a}
    of_first, of_last = [f"{x}_carry" for x in [*s, *g, *b]], [f"{x}_carry" for x in a]
    carried = ends.select(pid, side, *[c.alias(n) for n, c in carry.items()]).groupBy(pid).agg(
        *[F.max(F.when(F.col(side) == 1, F.struct(c)))[c].alias(c) for c in of_first], *[F.max(F.when(F.col(side) == 2, F.struct(c)))[c].alias(c) for c in of_last])

    whole = walked.join(F.broadcast(carried), pid, "left")  # one row per partition
    out = {n: (F.col(f"{x}_local") + F.coalesce(F.when(F.col(PREFIX + "head"), F.col(f"{x}_carry")), F.lit(0))).cast("bigint") for n, x in zip([*sums, *gaps], [*s, *g])}
    out |= {n: F.when(F.col(edge).bitwiseAND(F.lit(1).cast("tinyint")) > 0, F.col(f"{x}_carry")).otherwise(F.col(f"{x}_local")) for n, x in zip(previous, b)}
    out |= {n: F.when(F.col(edge).bitwiseAND(F.lit(2).cast("tinyint")) > 0, F.col(f"{x}_carry")).otherwise(F.col(f"{x}_local")) for n, x in zip(following, a)}
    return whole.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])
