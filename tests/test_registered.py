"""Every registered query against its DuckDB SQL at the smallest scale."""

import comparing
import pytest

import __spark_entry__ as contract
from reachlens.plans import queries

QUERIES, ORACLES = dict(queries.QUERIES), contract.oracle_sql()
# Filters that no row meets at the smallest scale; the larger scale of check.py fills them.
MAY_BE_EMPTY = {
    "axis_range_filter",
    "insight_high_spend_low_affinity",
    "insight_low_spend_high_affinity",
    "insight_top_competitor",
    "news_visible",
    "search_filter",
}


@pytest.fixture(scope="module")
def connection(small):
    return comparing.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(name, spark, small, connection):
    problems = comparing.differences(QUERIES[name](spark, small), connection, ORACLES[name])
    if name in MAY_BE_EMPTY:
        problems = [problem for problem in problems if problem != "no rows"]
    assert not problems


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:2] == ["category", "level"]
    assert frame.count() > 0
