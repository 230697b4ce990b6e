"""Every query of the subpackage with SQL gives the SQL's rows; every other one runs."""

import oracle
import pytest
from braidlog.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, D)
    if name in queries.ORACLE:
        assert oracle.difference(df, queries.ORACLE[name], D) == ""
    else:
        df.write.format("noop").mode("overwrite").save()
