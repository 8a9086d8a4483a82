import pytest

from plansift.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)
