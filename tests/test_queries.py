"""Every query with SQL gives the SQL's rows; every other one runs."""

import oracle
import pytest
from braidlog.plans import registry

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, registry.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in SQL:
        assert oracle.difference(df, SQL[name], D) == ""
    else:
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
