"""Every registered query against its SQL twin on the smallest folder."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from cohortloom.registry import base

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(base.QUERIES) == set(base.ORACLES)
    assert set(base.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_query(spark, con, name):
    status, note, *_ = compare(spark, con, FOLDER, name, entry.oracle_sql(), entry.queries())
    assert status == "OK", note
