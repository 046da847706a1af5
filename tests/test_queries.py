"""Every registered query against its SQL, on the smallest tables."""

import pytest

from quarryspark import queries

from .compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(queries.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
