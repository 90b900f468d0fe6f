"""Registered queries against their SQL, and that all thirteen are there."""

import pytest

from conftest import SMALL
from grove.llm.queries import ORACLES, QUERIES
from oracle_harness import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, n, _, _, detail = compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert ok and n, detail


def test_all_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert not set(ORACLES) - set(QUERIES)
