"""The registered queries on the test tables, against their SQL."""

import duckdb
import pytest

from commitlens.llm.queries import QUERIES, SQL
from compare import differences


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    assert differences(QUERIES[name](spark, sf_dir), connection, SQL[name])[:3] == []


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
