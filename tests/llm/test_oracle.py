"""The operators that SQL can say, against DuckDB."""

import pytest

from memlift.llm import queries
from tests.oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])
