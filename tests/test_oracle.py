"""Every query against DuckDB on the smallest tables; those without SQL have to give rows."""

import pytest

from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def _names():
    from curatrix.plans import stored  # noqa: F401  adds its queries
    from curatrix.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from curatrix.plans.queries import QUERIES, SQL

    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
