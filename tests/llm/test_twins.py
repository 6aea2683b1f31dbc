"""Corpus queries against their SQL twins on the smallest folder."""

import os
import re

import pytest

from check import compare, connect
from cohortloom.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_twin(spark, name):
    status, note, *_ = compare(spark, connect(FOLDER), FOLDER, name, registry.ORACLES,
                               registry.QUERIES)
    assert status == "OK", note


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
