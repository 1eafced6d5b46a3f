import pytest

from semlake.llm import queries as Q


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, same, name, sf):
    at = f"/root/testdata/{sf}"
    same(Q.QUERIES[name](spark, at), Q.SQL[name], at)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 11)}
