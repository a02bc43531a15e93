import pytest
from oracle import connect, rows_in, rows_of

from palimpsest.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_in(db, SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
