import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, oracle_connection

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    result = compare(spark, oracle, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert result.startswith(("same", "rows")), result


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
