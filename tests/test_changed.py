"""Work done again only where content has changed."""
import pytest
from pyspark.sql import functions as F

from dialoom.functions.stage import stage_dir
from dialoom.operators.changed import ChangedParts, content_fingerprints
from dialoom.sources.commit_log import Conflict

SCHEMA = "part string, sub int, v string"
ROWS = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("b", 1, ""), (None, None, "n"), (None, 1, "m")]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def upper(rows):
    return rows.select("part", "sub", F.upper("v").alias("u"))


def shown(kept, version=None):
    return sorted([tuple(r)[:3] for r in kept.read(version).select("part", "sub", "u").collect()], key=repr)


def want(rows):
    return sorted([(p, s, v and v.upper() or v) for p, s, v in rows], key=repr)


def test_one_changed_row_runs_one_part(spark):
    kept = ChangedParts(spark, stage_dir(spark), ["part", "sub"])
    assert kept.update(table(spark, ROWS), upper) == {"run": 5, "kept": 0, "removed": 0}
    assert kept.update(table(spark, ROWS[::-1]).repartition(3), upper) == {"run": 0, "kept": 5, "removed": 0} and kept.log.version() == 1
    seen = []

    def spied(rows):
        seen.extend(map(tuple, rows.collect()))
        return upper(rows)
    changed = [*ROWS[:4], (None, None, "other"), ROWS[5]]
    assert kept.update(table(spark, changed), spied) == {"run": 1, "kept": 4, "removed": 0}
    assert seen == [(None, None, "other")] and shown(kept) == want(changed) and shown(kept, 1) == want(ROWS)
    assert kept.read().select("run").distinct().count() == 2


def test_removed_parts_and_other_parameters(spark):
    kept = ChangedParts(spark, stage_dir(spark), ["part", "sub"])
    kept.update(table(spark, ROWS), upper)
    assert kept.update(table(spark, ROWS[:4]), upper) == {"run": 0, "kept": 3, "removed": 2} and shown(kept) == want(ROWS[:4])
    wider = lambda rows: upper(rows).withColumn("more", F.lit(1))
    assert kept.update(table(spark, ROWS[:4]), wider, "wider") == {"run": 3, "kept": 0, "removed": 0}
    assert kept.update(table(spark, ROWS), wider, "wider") == {"run": 2, "kept": 3, "removed": 0} and kept.read().where("more = 1").count() == 6
    assert kept.update(table(spark, []), wider, "wider")["removed"] == 5 and shown(kept) == []
    assert kept.update(table(spark, ROWS[:1]), wider, "wider")["run"] == 1 and shown(kept) == want(ROWS[:1])


def test_failed_and_simultaneous_runs_leave_nothing(spark):
    folder = stage_dir(spark)
    kept = ChangedParts(spark, folder, ["part", "sub"])
    with pytest.raises(FileNotFoundError):
        kept.read()
    assert kept.update(table(spark, []), upper) == {"run": 0, "kept": 0, "removed": 0}

    def broken(rows):
        raise RuntimeError("down")
    with pytest.raises(RuntimeError):
        kept.update(table(spark, ROWS), broken)
    assert kept.log.version() == 0

    def overtaken(rows):
        ChangedParts(spark, folder, ["part", "sub"]).update(table(spark, ROWS[:2]), upper)
        return upper(rows)
    with pytest.raises(Conflict):
        kept.update(table(spark, ROWS), overtaken)
    assert shown(kept) == want(ROWS[:2])
    kept.update(table(spark, ROWS), upper)
    assert shown(kept) == want(ROWS)


def test_fingerprints_tell_contents_apart(spark):
    rows = lambda *r: content_fingerprints(spark.createDataFrame([(1, *x) for x in r], "k int, a string, b string"), ["k"]).first()["fingerprint"]
    kinds = [rows(("x", None)), rows((None, "x")), rows(("x", "")), rows(("x", None), ("x", None)), rows(("x", None), ("y", None)), rows(("x", "y"), (None, None))]
    assert len(set(kinds)) == len(kinds) and rows(("x", None), ("y", None)) == rows(("y", None), ("x", None))
