"""Every registered query that has SQL against it at the smallest scale."""

import importlib.util

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OPTIONAL = importlib.util.find_spec("evalgrain.llm") is not None


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# At this scale these find nothing to report, so only their agreement counts.
EMPTY_IS_FINE = "no rows"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    problem = compare(spark, duck, name, QUERIES[name], ORACLES[name], FOLDER)
    assert problem in (None, EMPTY_IS_FINE)


def test_every_query_has_an_oracle():
    """Queries without SQL are tested against brute force beside their operators, which are optional."""
    without = set(QUERIES) - set(ORACLES)
    assert set(ORACLES) <= set(QUERIES)
    assert all(name == "pipeline" or name.startswith("op") for name in without)
    assert OPTIONAL or not without


def test_entry(spark):
    assert entry.entry(spark).count() == 3
