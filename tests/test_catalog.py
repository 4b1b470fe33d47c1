"""Every registered query with SQL gives the rows of that SQL; the others give some rows."""

from __future__ import annotations

import os

import pytest

from check import compare, connect
from turnwise.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
