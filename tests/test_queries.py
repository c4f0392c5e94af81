"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from ledgergraph.plans import QUERIES
from tests.oracle import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
CHECKS = entry.oracle_sql()

NAMES = list(QUERIES)  # those of ledgergraph.llm have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message, _, _ = compare(spark, con, name, entry.queries()[name], CHECKS.get(name), SF)
    assert ok, message


def test_entry(spark):
    if os.path.isdir(entry.SMOKE):
        assert entry.entry(spark).count() > 0


def test_names():
    assert set(CHECKS) <= set(entry.queries())
    assert all(CHECKS.get(n) for n in QUERIES)
