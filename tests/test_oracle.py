"""Every registered query against its SQL twin, or for rows where SQL cannot say it."""

import pytest

from sparcel.plans import load_all
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(load_all()))
def test_query(spark, duck, name):
    q = load_all()[name]
    df = q.build(spark, SF)
    if q.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, q.sql) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
