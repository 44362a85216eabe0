"""Seeded shards, IPv6 by expressions, token counts from outside."""
import ipaddress
import random

from pyspark.sql import functions as F

from dialoom.operators import extract, messages, sampling


def test_shards_are_the_same_for_any_partitioning(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("position"))
    seen = [{r.id: (r.position, r.shard) for r in sampling.shuffled_shards(rows.repartition(n, by), 5, ["id"], 6).collect()} for n, by in ((1, "id"), (13, "position"))]
    assert seen[0] == seen[1] and sorted(p for p, _ in seen[0].values()) == list(range(1000))
    sizes = [sum(s == k for _, s in seen[0].values()) for k in range(6)]
    assert set(sizes) == {166, 167} and all(s == p * 6 // 1000 for p, s in seen[0].values())
    other = {r.id: r.position for r in sampling.shuffled_shards(rows, 6, ["id"], 6).collect()}
    assert sum(other[i] == seen[0][i][0] for i in other) < 20
    # uniform: of each third of the ids about a third lies in each third of the order (5 standard deviations)
    for third in range(3):
        hits = [sum(seen[0][i][0] * 3 // 1000 == k for i in range(third * 334, min(1000, third * 334 + 334))) for k in range(3)]
        assert all(abs(h - sum(hits) / 3) < 5 * 8.7 for h in hits)


def test_shards_of_few_repeated_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id int, t string")
    got = sampling.shuffled_shards(few, 1, ["id"], 10).collect()
    assert sorted(r.position for r in got) == [0, 1, 2] and all(r.shard == r.position * 10 // 3 for r in got)
    assert sampling.shuffled_shards(few.limit(0), 1, ["id"], 10).collect() == []


def valid(host):
    try:
        ipaddress.IPv6Address(host)
        return True
    except ValueError:
        return False


def test_ipv6_as_the_standard_library_sees_it(spark):
    r = random.Random(4)
    parts = ["", "", "0", "1", "ab", "ffff", "12345", "g", "1.2.3.4", "1.2.3.256", "01.2.3.4", "::"]
    hosts = [":".join(r.choice(parts) for _ in range(r.randint(2, 10))) + r.choice(["", "", "", "%eth0", "%", "%a%b", "/64"]) for _ in range(8000)]
    hosts += [":".join(["1"] * n) + end for n in range(1, 11) for end in ("", ":", "::", "::1", ":1.2.3.4", "::1.2.3.4")]
    hosts += ["::", ":::", "1::", "::1", ":1", "1:", "::1%lo", ":" * 9, "a:" * 50_000 + "a", "::ffff:1.2.3.4", "1::2::3", "::1\n2"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    wrong = [(r.host[:80], r.valid_host) for r in extract.flag_valid_hosts(df).collect() if ":" in r.host and r.valid_host != valid(r.host.strip().lower())]
    assert not wrong
    rows = extract.flag_valid_hosts(spark.createDataFrame([(None,), ("",), (" LocalHost ",), ("a.b",), ("a.bc",), ("1.2.3.4",)], "host string")).collect()
    assert [r.valid_host for r in rows] == [False, False, True, False, True, True]


def test_token_counts_come_from_a_column_or_the_words(spark):
    prompts = spark.createDataFrame([(1, "m", "a b c d", 9), (2, "m", "a b c d", None), (3, "m", None, None), (4, "x", "a", 99)], "id int, model string, prompt string, tokens int")
    limits = spark.createDataFrame([("m", 6, 1)], "model string, context_length int, tokens int")
    got = messages.context_budget_flags(prompts, limits, tokens=F.col("tokens")).orderBy("id").collect()
    assert [(r.estimate, r.too_long) for r in got] == [(9, True), (6, False), (0, False), (99, False)]
    assert [r.estimate for r in messages.context_budget_flags(prompts, limits.drop("tokens")).orderBy("id").collect()] == [6, 6, 0, 2]
