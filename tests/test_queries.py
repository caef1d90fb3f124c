import os

import pytest

from siltstone import queries

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert queries.flagship(spark, FOLDER).count() > 0
