import pytest

from keystrata.llm.queries import QUERIES, SQL

from ..conftest import SMALL, same_rows


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, SQL[name])
