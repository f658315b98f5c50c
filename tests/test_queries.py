import __spark_entry__ as entry_point
import pytest
from check_queries import connect, difference

from fareline.catalog import all_queries

QUERIES = all_queries()
# Whole model searches for rows of numbers and marks; scripts/check_queries.py runs them.
LONG = {"model_record_sides", "holdout_scores", "cv_settings", "stage_sides"}


@pytest.fixture(scope="module")
def tables(small_folder):
    return connect(small_folder)


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if query.sql and name not in LONG])
def test_query_equals_its_sql(spark, tables, small_folder, name):
    query = QUERIES[name]
    actual = query.run(spark, small_folder).toPandas()
    problem = difference(actual, tables.execute(query.sql).df())
    assert problem is None, problem


def test_fingerprints_run(spark, small_folder):
    assert QUERIES["file_fingerprint"].run(spark, small_folder).count() == 14


def test_entry_points(spark):
    assert entry_point.entry(spark).count() == 7
    assert set(entry_point.oracle_sql()) < set(entry_point.queries())
