"""The registered corpus queries that SQL can express, against it; all of them are there."""

import pytest

import __spark_entry__ as entry
from mediacat.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    assert difference(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


def test_names():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
