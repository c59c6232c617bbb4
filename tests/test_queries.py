"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    return duck(FOLDER)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, oracle, name):
    assert compare(spark, oracle, FOLDER, name, queries()[name], oracle_sql().get(name)) is None
