"""Every query of the library against its SQL on the smallest tables; those without SQL must run and keep their schema."""

import pytest

from memlift.plans import registry

from tests.oracle import connect, spark_rows, sql_rows

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert spark_rows(df) == sql_rows(con, registry.ORACLE_SQL[name])
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
