"""Every named query against its SQL on the given tables."""

import pytest

import compare
from waveloom import queries

NAMES = sorted(queries.all_queries())
SQL = queries.all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    df = queries.all_queries()[name](spark, sf_dir)
    if name in SQL:
        assert compare.differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0
