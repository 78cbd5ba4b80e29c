"""Every query that has SQL gives the SQL's rows."""

import pytest

from loomroute import catalog

from support import duck_rows, rows_of

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == duck_rows(duck, SQL[name], columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
