import pytest
from oracle import rows_of, rows_of_sql

from lodestar import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_same_as_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(queries.oracle_sql()[name], SF)
