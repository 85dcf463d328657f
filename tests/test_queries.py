import pytest
from oracle import DATA
from oracle import compare

from foliate.plans.oracles import ORACLE_SQL
from foliate.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    df = QUERIES[name](spark, folder)
    compare(df, ORACLE_SQL[name], folder)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
