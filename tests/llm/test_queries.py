"""The registered queries against their SQL, and the registry's shape."""

import pytest

from sparkloom.llm.queries import QUERIES, SQL
from tests.oracles import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert SQL.keys() <= QUERIES.keys()
