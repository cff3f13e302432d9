"""Every registered query of the library runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as driver
from factweave.registry import ORACLES, QUERIES
from tests.compare import database, differences

driver.queries()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(n for n, f in QUERIES.items() if ".llm." not in f.__module__))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0  # see test_against_python
