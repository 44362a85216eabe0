"""Rounds of generation until n rows are accepted."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions.draws import draw_hash
from dialoom.operators import extend as X
from dialoom.operators.accept import accept_until


def accepting(one_in, log):
    """A generator that accepts every `one_in`-th id and counts what it is asked."""
    def run(rows):
        ids = [r.id for r in rows.select("id").collect()]
        log.append(ids)
        return rows.where(F.col("id") % one_in == 0).withColumn("made", F.concat(F.lit("row "), "id"))
    return run


def in_order(df, seed, one_in, n):
    """Asking one by one: (accepted ids, number asked)."""
    got, asked = [], 0
    for r in df.withColumn("o", draw_hash(seed, ["id"], "accept")).orderBy("o", "id").collect():
        asked += 1
        if r.id % one_in == 0:
            got.append(r.id)
            if len(got) == n:
                break
    return sorted(got), asked


@pytest.mark.parametrize("one_in, n, growth", [(1, 40, 0.5), (2, 40, 0.5), (7, 40, 0.5), (7, 10, 1.0), (50, 3, 0.25)])
def test_equals_asking_one_by_one(spark, one_in, n, growth):
    df, log = spark.range(2000), []
    done = accept_until(df, accepting(one_in, log), n, 5, ["id"], growth=growth)
    want, needed = in_order(df, 5, one_in, n)
    assert sorted(r.id for r in done.rows.collect()) == want and len(want) == n
    asked = [i for ids in log for i in ids]
    assert len(asked) == len(set(asked)) == done.asked.first()["asked"] <= (1 + growth) * needed
    assert done.rows.columns == ["id", "made"] and done.rounds == len(log) and (one_in == 1) == (len(log) == 1)


def test_groups_and_too_few(spark):
    df, log = spark.range(600).withColumn("g", F.when(F.col("id") < 20, None).when(F.col("id") < 300, "a").otherwise("b")), []
    done = accept_until(df, accepting(4, log), 12, 1, ["id"], ["g"])
    counts = {r.g: r["count"] for r in done.rows.groupBy("g").count().collect()}
    assert counts == {None: 5, "a": 12, "b": 12}  # the null group has five rows that can be accepted, and all were asked
    assert {r.g: (r.asked, r.there) for r in done.asked.collect()}[None] == (20, 20)
    for g in ("a", "b"):
        part = df.where(F.col("g") == g)
        assert sorted(r.id for r in done.rows.where(F.col("g") == g).collect()) == in_order(part, 1, 4, 12)[0]


def test_none(spark):
    done = accept_until(spark.range(0), accepting(1, []), 5, 1, ["id"])
    assert done.rows.count() == 0 and done.rounds == 0
    log = []
    done = accept_until(spark.range(30).where("id % 2 = 1"), accepting(2, log), 5, 1, ["id"])
    assert done.rows.count() == 0 and sum(map(len, log)) == 15


def test_goes_on_after_a_failure_and_to_a_larger_n(spark, tmp_path):
    df, log, path = spark.range(1000), [], f"file://{tmp_path}/rounds"

    def failing(rows):
        if len(log) == 2:
            raise RuntimeError("service is down")
        return accepting(6, log)(rows)

    with pytest.raises(RuntimeError, match="down"):
        accept_until(df, failing, 30, 9, ["id"], path=path)
    before, more = list(log), []
    done = accept_until(df, accepting(6, more), 30, 9, ["id"], path=path)
    want, needed = in_order(df, 9, 6, 30)
    assert sorted(r.id for r in done.rows.collect()) == want
    once = [i for ids in before + more for i in ids]
    assert len(once) == len(set(once)) <= 1.5 * needed  # nothing was asked twice
    larger = []
    done = accept_until(df, accepting(6, larger), 60, 9, ["id"], path=path)
    assert sorted(r.id for r in done.rows.collect()) == in_order(df, 9, 6, 60)[0]
    assert not set(once) & {i for ids in larger for i in ids}


def test_with_a_model(spark):
    """Contexts go to a model in batches; answers without the fields are rejected and made up for."""
    def model(talks):
        out = []
        for talk in talks:
            h = int(hashlib.md5(talk[-1]["content"].encode()).hexdigest()[:8], 16)
            out.append(json.dumps({"phrase": f"say {h}"}) if h % 3 == 0 else "no JSON" if h % 3 == 1 else '{"phrase": " "}')
        return out

    def generate(rows):
        asked = X.complete_batch(rows.withColumn("prompt", F.concat(F.lit("thing "), "id")), model, max_attempts=1)
        return X.check_generated_rows(asked, ["phrase"])[0].select("id", "phrase")

    done = accept_until(spark.range(400), generate, 25, 3, ["id"])
    rows = done.rows.collect()
    assert len(rows) == 25 and all(r.phrase == f"say {int(hashlib.md5(f'thing {r.id}'.encode()).hexdigest()[:8], 16)}" for r in rows)
