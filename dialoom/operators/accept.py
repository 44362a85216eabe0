"""Asking a generator for candidates, round by round, until enough of its rows are accepted.

The candidates of each group stand in a seeded order, and a cursor walks along it. Every round asks for the next stretch, as long
as the acceptance so far makes necessary, and stages what came back. The result is the first n accepted
rows of the order, whatever the rounds were, so it equals that of asking one by one and stopping at the n-th.

A round never asks for more than `growth` times what its group was asked before, and the first asks for n. Asking one by one would
have asked all but the last round too, so a group is asked at most 1 + growth times as often as necessary.
"""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions.draws import draw_hash
from dialoom.functions.scan import scan
from dialoom.functions.stage import stage, stage_dir

PLACE = "_place"  # in the seeded order of a group, from 1


@dataclass
class Accepted:
    """rows: the accepted rows; asked: per group how many candidates were asked, were accepted and there are; rounds: how many were run now."""

    rows: DataFrame
    asked: DataFrame
    rounds: int


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has completed its output there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def accept_until(candidates: DataFrame, generate: Callable[[DataFrame], DataFrame], n: int, seed, keys, group=(), growth=0.5, margin=1.1,
                 path: str | None = None, max_rounds=200) -> Accepted:
    """Exactly n accepted rows per group (all if there are fewer), in the seeded order of the candidates.

    `keys` are unique in `candidates` and not null. `generate(candidates)` returns the accepted rows: the keys and whatever it
    adds; candidates it leaves out are rejected. It is called once per round and its result is staged, so
    a model behind it isn't asked twice. Under `path`, a shared folder, completed rounds stay: a run that was broken off, or one with a larger n,
    goes on behind them. The path belongs to one seed, set of candidates and generator.
    """
    spark, keys, group = candidates.sparkSession, list(keys), list(group)
    over = group or ["_whole"]
    held = candidates if group else candidates.withColumn("_whole", F.lit(0))
    order = held.withColumn("_order", draw_hash(seed, keys, "accept"))
    # Numbered and sorted by (group, order): a round reads the files that hold its stretch.
    placed = stage(scan(order, over, ["_order", *keys], sums={PLACE: F.lit(1)}).drop("_order"))
    sizes = stage(placed.groupBy(*over).agg(F.max(PLACE).alias("there")))
    folder = path or stage_dir(spark)
    rounds, now, kept = 0, 0, []
    while rounds < max_rounds:
        at = f"{folder}/round-{rounds:04d}"
        if not _written(spark, at):
            state = _state(sizes, kept, over)
            short = stage(_next(state, n, growth, margin))
            if short.isEmpty():
                break
            asked = placed.join(short, [F.col(f"{PLACE}") > F.col("asked"), F.col(PLACE) <= F.col("asked") + F.col("ask"), *[placed[c].eqNullSafe(short[c]) for c in over]])
            asked = stage(asked.select(*[placed[c] for c in placed.columns]))
            found = generate(asked.drop(PLACE, "_whole"))
            added = [c for c in found.columns if c not in asked.columns]
            rows = asked.join(found.select(*keys, *added, F.lit(True).alias("_accepted")), keys, "left").withColumn("_accepted", F.coalesce("_accepted", F.lit(False)))
            rows.write.mode("overwrite").parquet(at)
            now += 1
        kept.append(spark.read.parquet(at))
        rounds += 1
    else:
        raise RuntimeError(f"not enough accepted rows after {max_rounds} rounds")
    state = _state(sizes, kept, over).drop(*([] if group else ["_whole"]))
    if not kept:
        return Accepted(candidates.limit(0), state, 0)
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy(*over).orderBy(PLACE))  # Spark applies the limit before the shuffle
    best = every.where("_accepted").withColumn("_rank", rank).where(F.col("_rank") <= n)
    return Accepted(best.drop(PLACE, "_rank", "_accepted", "_whole"), state, now)


def _state(sizes: DataFrame, kept: list, over: list) -> DataFrame:
    """Per group: there, asked, accepted."""
    state = sizes.withColumns({"asked": F.lit(0).cast("bigint"), "accepted": F.lit(0).cast("bigint")})
    if kept:
        counts = kept[0].select(*over, "_accepted")
        for more in kept[1:]:
            counts = counts.union(more.select(*over, "_accepted"))
        counts = counts.groupBy(*over).agg(F.count(F.lit(1)).alias("c_asked"), F.count_if("_accepted").alias("c_accepted"))
        same = [sizes[c].eqNullSafe(counts[c]) for c in over]
        state = sizes.join(counts, same, "left").select(*[sizes[c] for c in sizes.columns], F.coalesce("c_asked", F.lit(0)).alias("asked"), F.coalesce("c_accepted", F.lit(0)).alias("accepted"))
    return state


def _next(state: DataFrame, n: int, growth: float, margin: float) -> DataFrame:
    """Groups that need more, with `asked` and how many to `ask`: what is missing divided by the share accepted so far, and a little more."""
    missing = F.lit(n) - F.col("accepted")
    share = (F.col("accepted") + 1) / (F.col("asked") + 1)
    guess = F.when(F.col("asked") == 0, missing).otherwise(F.least(F.ceil(missing / share * margin), F.greatest(F.lit(1), F.floor(F.col("asked") * growth))))
    return state.where((F.col("accepted") < n) & (F.col("asked") < F.col("there"))).withColumn("ask", guess.cast("bigint")).drop("there", "accepted")
