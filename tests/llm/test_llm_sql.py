import pytest
from check_queries import connect, difference

from fareline.llm import queries


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, small_folder, name):
    actual = queries.QUERIES[name](spark, small_folder).toPandas()
    problem = difference(actual, connect(small_folder).execute(queries.SQL[name]).df())
    assert problem is None, problem
