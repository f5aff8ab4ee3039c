"""Every registered query with SQL gives the same rows as DuckDB; the others run."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("q_") or n.split("_")[0] in ("p3", "p4")])
def test_query(spark, con, name):
    good, said = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good is not False, said


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
