import pytest

import __spark_entry__ as entry
from semlake import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_same_as_sql(spark, same, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name], SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o", "total", "name", "region"] and df.count() == 1500
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(entry.oracle_sql())
