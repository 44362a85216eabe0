"""A model that fails is not taken for one that had nothing to say."""
import pytest
from pyspark.sql import functions as F

from dialoom.operators import extend as E


def _services(spark):
    return spark.createDataFrame([("light.turn_on",), ("lock.lock",), ("lock.lock",)], "service string")


def test_a_failing_function_leaves_no_empty_result(spark):
    def complete(talks):
        return [t[0]["content"].split("words that are not there")[1] for t in talks]
    with pytest.raises(E.NoAnswer, match="2 of 2 rows have no answer.*IndexError"):
        E.extend_persona(_services(spark), F.lit("pirate"), F.lit("salty"), complete)
    rows, bad = E.extend_persona(_services(spark), F.lit("pirate"), F.lit("salty"), complete, failed="return")
    assert rows.count() == 0 and {(r.service, r.error) for r in bad.collect()} == {(s, "IndexError: list index out of range") for s in ("light.turn_on", "lock.lock")}
    with pytest.raises(E.NoAnswer):
        E.generate_device_names(spark.createDataFrame([("light",)], "type string"), complete)
    with pytest.raises(E.NoAnswer):
        E.generate_persona_prompts(spark.createDataFrame([("pirate", "salty")], "persona string, about string"), complete)


def test_one_service_without_a_response_is_named(spark):
    def complete(talks):
        return ["Aye" if "lock" in t[0]["content"] else "NORMAL: Aye, on\nSHORT: On" for t in talks]
    with pytest.raises(E.NoAnswer, match="1 of 2 rows have no answer: 1 x no tagged line"):
        E.extend_persona(_services(spark), F.lit("pirate"), F.lit("salty"), complete)
    rows, bad = E.extend_persona(_services(spark), F.lit("pirate"), F.lit("salty"), complete, failed="return")
    assert sorted((r.service, r.response, r.short) for r in rows.collect()) == [("light.turn_on", "Aye, on", 0), ("light.turn_on", "On", 1)]
    assert [(r.service, r.answer, r.error) for r in bad.collect()] == [("lock.lock", "Aye", "no tagged line")]


def test_a_lost_answer_shifts_no_other(spark):
    def complete(talks):  # says nothing about a prompt it can't answer
        return ["about " + t[0]["content"] for t in talks if t[0]["content"] != "b"]
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "prompt string").coalesce(1)
    rows = E.complete_batch(df, complete, max_attempts=2, partitions=1).collect()
    assert len(rows) == 4 and all(r.answer is None and r.attempts == 2 and r.error == "3 answers to 4 prompts" for r in rows)


def test_stand_ins_read_the_prompts(spark, sf_dir):
    from dialoom.plans import extend as P
    services = P.spark_input(spark, sf_dir, "pile_responses").select("service").distinct().count()
    assert P.g7_extend_persona(spark, sf_dir).count() == 2 * services > 0
    assert P.g8_split_responses(spark, sf_dir).where("response_starting like '%Character of the assistant%'").count() == 0
