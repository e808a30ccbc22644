"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

from clickloom.plans.queries import REGISTRY
from compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.sql is not None])
def test_equal(spark, con, name):
    assert compare(con, REGISTRY[name], spark, SF) is None
