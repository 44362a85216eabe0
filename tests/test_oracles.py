"""Every registered query against its SQL on the given tables."""
import harness
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


def test_entry(spark):
    rows = entry.entry(spark).collect()
    total = [r for r in rows if r["level"] == 7]
    assert len(total) == 1 and 0 < total[0]["accuracy"] < 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ok, message = harness.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, message
    assert "TYPES" not in message, message
