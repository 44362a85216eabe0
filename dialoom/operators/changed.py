"""Work that is done again only for the parts of a table whose content has changed."""
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.stage import stage
from dialoom.sources.commit_log import CommitLog, Conflict


def content_fingerprints(rows: DataFrame, keys, parameters="") -> DataFrame:
    """One row per part (the columns `keys`): n rows, and `fingerprint`, which depends on the rows and the parameters but not on the rows' order.

    Each row counts with two 64-bit hashes of its whole content as JSON (so that NULL, empty and neighbouring values stay apart), and a part
    with their sums, so repeated rows count as often as they occur. The sums are partial aggregates: a part with a third of all rows burdens no task.
    """
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), content).cast("decimal(38,0)")).cast("string")
    given = F.lit(f"{len(parameters)}:{parameters}")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), total("a").alias("_a"), total("b").alias("_b")).select(
        *keys, "n", F.sha2(F.concat_ws("/", given, F.col("n").cast("string"), "_a", "_b"), 256).alias("fingerprint"))


def _same(left: str, right: str, keys) -> Column:
    """Equal keys, NULL being equal to NULL."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


class ChangedParts:
    """Results of a job over a table cut into parts, kept in `folder` and brought up to date part by part.

    The folder holds `runs/run=<id>` (the rows that one run made), `parts/<id>` (every part's fingerprint and the run that made its rows) and a
    commit log that names them. The rows must not change while a run reads them, and may have no column `run`. A run that fails, or is done twice, leaves nothing that readers see; of two runs at the same time the second fails with `Conflict`.
    """

    def __init__(self, spark: SparkSession, folder: str, keys):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _parts(self, version: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/parts/{self.log.commits(version - 1, version)[0]['id']}") if version else None

    def update(self, rows: DataFrame, job: Callable[[DataFrame], DataFrame], parameters="") -> dict:
        """Run `job` over the rows of the parts that are new, changed, or were made with other parameters.

        The job has to keep the key columns and make a part's rows from that part alone; `parameters` is any text that stands for the job's
        version and settings. Parts that are gone lose their results. Returns the counts of parts that were run, kept and removed; without any
        change nothing is written.
        """
        seen = self.log.version()
        now, old = stage(content_fingerprints(rows, self.keys, parameters)), self._parts(seen)
        if old is None:
            old = now.limit(0).withColumn("run", F.lit(None).cast("string"))
        known = F.col("o.fingerprint") == F.col("p.fingerprint")
        state = now.alias("p").join(old.alias("o"), _same("p", "o", self.keys), "left").select("p.*", F.when(known, F.col("o.run")).alias("run"))
        counts = state.agg(F.count("run").alias("kept"), F.count_if(F.col("run").isNull()).alias("run")).first()
        removed = old.alias("o").join(now.alias("p"), _same("o", "p", self.keys), "left_anti").count()
        done = {"run": counts["run"], "kept": counts["kept"], "removed": removed}
        if not (done["run"] or removed):
            return done
        run = f"r{uuid.uuid4().hex}"  # never taken for a number
        parts = state.withColumn("run", F.coalesce("run", F.lit(run)))
        parts.write.parquet(f"{self.folder}/parts/{run}")
        parts = self.spark.read.parquet(f"{self.folder}/parts/{run}")
        if done["run"]:
            changed = parts.where(F.col("run") == run)
            job(rows.alias("r").join(changed.alias("c"), _same("r", "c", self.keys), "left_semi")).write.parquet(f"{self.folder}/runs/run={run}")
        live = sorted(r["run"] for r in parts.select("run").distinct().collect())  # one for each run at most
        if not self.log.claim(seen + 1, {"id": run, "runs": live}):
            raise Conflict("another run has brought these results up to date meanwhile")
        return done

    def read(self, version: int | None = None) -> DataFrame:
        """The results of a version (default: the last), with `run`, the name of the run that made a row. Columns that a run lacks are NULL."""
        version = self.log.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"no run has been completed in {self.folder}")
        parts, runs = self._parts(version), self.log.commits(version - 1, version)[0]["runs"]
        if not runs:  # every part is gone
            before = self.read(version - 1)
            return before.limit(0)
        rows = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.folder}/runs").parquet(*[f"{self.folder}/runs/run={r}" for r in runs])
        on = _same("d", "p", self.keys) & (F.col("d.run") == F.col("p.run"))
        return rows.alias("d").join(parts.select(*self.keys, "run").alias("p"), on, "left_semi")
