"""Every registered query against its independent SQL."""

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as driver

# The pipeline's operators, where they are installed, have tests of their own.
OTHERS = {*driver.llm.QUERIES, "pipeline"} if driver.llm is not None else set()
QUERIES = {key: query for key, query in driver.queries().items() if key not in OTHERS}
ORACLES = {key: sql for key, sql in driver.oracle_sql().items() if key not in OTHERS}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = oracle_connection(sf_dir)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", QUERIES)
def test_query_matches_its_oracle(spark, sf_dir, duck, key):
    found = differences(QUERIES[key](spark, sf_dir), duck, ORACLES[key])
    assert not found, f"{len(found)} differences: {found[:5]}"


def test_entry_runs(spark):
    rows = driver.entry(spark).collect()
    assert rows and {"ServiceName", "ResourceCovPct"} <= set(rows[0].asDict())
