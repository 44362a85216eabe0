"""Connected components of a table of links, by alternating large and small stars."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node (bigint) reachable, for every node that has a link.

    Large star: every node hands its larger neighbours to the smallest node around it. Small star: every node hands
    itself and its smaller neighbours to the smallest of them. Both keep components and only shorten paths, so after
    about log(n) rounds every node hangs from its component's smallest node. Links never outnumber those of the
    start, minima are formed before the shuffle, and each round is staged, so a lost executor repeats one round.
    Links of a node to itself make it a component of its own. No links: no rows.
    """
    ab = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    loops = ab.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    now = stage(ab.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stage(small)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum over them: equal marks mean that nothing changed."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
