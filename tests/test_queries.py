"""Every registered query of the library against its SQL twin, on the smallest tables."""

import pytest
from oracle import connect, differs

from loglattice.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, con, name):
    assert not differs(spark, QUERIES[name], ORACLE[name], SF, con)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
