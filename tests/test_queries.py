"""Every query against its SQL over the smallest tables; those without SQL have to run."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        assert not difference(df, con, ORACLE[name])
    else:
        df.collect()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
