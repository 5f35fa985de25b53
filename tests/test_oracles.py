"""Every registered query runs at the smallest scale and equals its SQL oracle."""

import pytest

import __spark_entry__ as entry
from corpusq.checks.compare import compare, oracle_connection


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    status, detail, _, _ = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows"), detail


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"lang", "total_chunks", "quality_score"} <= set(rows[0].asDict())
