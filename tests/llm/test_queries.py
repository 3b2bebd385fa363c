import pytest

from chronoloom.llm import queries
from tests.oracle import compare

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], SQL[name])
