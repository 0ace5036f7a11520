import pytest

from compare import connect, difference
from tailcast.llm import queries, sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sql.ORACLE)
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), connect(SMALL), sql.ORACLE[name])[0] == ""


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and set(sql.ORACLE) <= set(queries.QUERIES)
