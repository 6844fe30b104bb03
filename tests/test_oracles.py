"""Every registered query against its SQL oracle on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    status, _, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert status in ("ok", "EMPTY", "rows-only"), note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
