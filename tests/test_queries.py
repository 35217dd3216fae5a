import pytest

from keystrata.queries import QUERIES, SQL

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_cursors_of_every_row(spark):
    assert QUERIES["cursors_of_all"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
