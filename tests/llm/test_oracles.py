"""Queries that SQL can express against their oracles."""

import pytest
from conftest import SF
from oracle import differences

from loam.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) == ""


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
