import pytest
from oracle import DATA
from oracle import compare

from foliate.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    compare(QUERIES[name](spark, folder), ORACLE_SQL[name], folder)
