"""Function-call accuracy from expected and actual calls.

Matching works on counts: equal calls of one example are one group, and the smaller of the two
counts is matched. Every step is a sum, so partial aggregation shrinks hot keys before a shuffle
and no example's calls are ever held together in memory.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.args import canonical_args, json_object

RELAXED = ("rgb_color",)


def _call_counts(calls: DataFrame, keys, side, relax):
    args = json_object(F.col("args"))
    has_all = F.lit(True)
    for k in relax:
        has_all = has_all & F.map_contains_key(args, k)
    call = F.struct("tool_name", "args")
    loose = F.when(has_all, F.struct("tool_name", canonical_args(args, drop=relax).alias("args")))
    bad = F.col("error").isNotNull()
    return calls.select(*keys, F.when(~bad, call).alias("call"), F.when(~bad, loose).alias("loose"),
                        F.lit(1 if side == "e" else 0).alias("e"), F.lit(1 if side == "a" else 0).alias("a"),
                        bad.cast("int").alias("bad"))


def score_tool_calls(examples: DataFrame, expected: DataFrame, actual: DataFrame, keys, relax=RELAXED) -> DataFrame:
    """One row per example: possible, correct, color_mismatch and the failure counts.

    `examples` lists the keys to score (with any further columns to carry along); `expected` and
    `actual` hold normalised calls (tool_name, args, error). An example that expects nothing is
    one possible answer, correct when nothing was called.
    """
    rows = _call_counts(expected.filter(F.col("error").isNull()), keys, "e", relax) \
        .unionByName(_call_counts(actual, keys, "a", relax))
    per_call = rows.groupBy(*keys, "call", "loose").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum("bad").alias("bad"))
    good = F.col("call").isNotNull()
    hit = F.when(good, F.least("e", "a")).otherwise(0)
    per_loose = per_call.withColumn("hit", hit).groupBy(*keys, "loose").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum("hit").alias("hit"),
        F.sum(F.when(good, F.col("e") - F.col("hit")).otherwise(0)).alias("left_e"),
        F.sum(F.when(good, F.col("a") - F.col("hit")).otherwise(0)).alias("left_a"),
        F.sum("bad").alias("bad"))
    near = F.when(F.col("loose").isNotNull(), F.least("left_e", "left_a")).otherwise(0)
    per_example = per_loose.withColumn("near", near).groupBy(*keys).agg(
        F.sum("e").alias("n_expected"), F.sum("a").alias("n_found"), F.sum("hit").alias("hit"),
        F.sum("near").alias("near"), F.sum("bad").alias("bad"))
    scored = examples.join(per_example, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    wanted, found = zero("n_expected"), zero("n_found")
    nothing = wanted == 0
    count_if = lambda cond, value: F.when(cond, value).otherwise(F.lit(0)).cast("bigint")
    both = (wanted > 0) & (found > 0)
    return scored.select(
        *[F.col(c) for c in examples.columns],
        F.greatest(wanted, F.lit(1)).cast("bigint").alias("possible"),
        F.when(nothing, (found == 0).cast("bigint")).otherwise(zero("hit") + zero("near")).alias("correct"),
        zero("near").alias("color_mismatch"),
        count_if(nothing & (found > 0), F.lit(1)).alias("extra_response"),
        count_if((wanted > 0) & (found == 0), F.lit(1)).alias("no_response_found"),
        count_if(both, zero("bad")).alias("invalid_json"),
        count_if(both, found - zero("bad") - zero("hit") - zero("near")).alias("mismatch"))


FAILURES = ("extra_response", "no_response_found", "invalid_json", "mismatch")


def classify_failures(scored: DataFrame, keys) -> DataFrame:
    """One row per example and failure class that occurred, with its count."""
    pairs = F.array(*[F.struct(F.lit(f).alias("failure"), F.col(f).alias("n")) for f in FAILURES])
    return scored.select(*keys, F.explode(F.filter(pairs, lambda p: p["n"] > 0)).alias("p")) \
        .select(*keys, "p.failure", "p.n")


def accuracy_report(scored: DataFrame, dims=("model", "checkpoint", "language")) -> DataFrame:
    """Accuracy with subtotals over `dims` from left to right; `level` tells the subtotal depth."""
    return scored.rollup(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("possible").alias("possible"), F.sum("correct").alias("correct"),
        F.sum("color_mismatch").alias("color_mismatch")) \
        .withColumn("accuracy", F.col("correct") / F.col("possible"))


def checkpoint_progress(report: DataFrame, run="model", checkpoint="checkpoint") -> DataFrame:
    """Order a run's checkpoints by step (a name without a number comes last) with the gain over
    the one before and a mark on the best. One row per checkpoint, so groups stay small."""
    step = F.regexp_extract(F.col(checkpoint).cast("string"), r"(\d+)$", 1).try_cast("bigint")
    ordered = Window.partitionBy(run).orderBy(F.asc_nulls_last("step"), checkpoint)
    best = Window.partitionBy(run).orderBy(F.desc("accuracy"), F.asc_nulls_last("step"), checkpoint)
    return report.withColumn("step", step).withColumns({
        "place": F.row_number().over(ordered),
        "gain": F.col("accuracy") - F.lag("accuracy").over(ordered),
        "is_best": F.row_number().over(best) == 1})
