"""Queries with SQL: the same rows from DuckDB on the driver's tables."""

import pytest
from oracle_harness import compare

from sluice.llm.register import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    problems, n = compare(spark, key, QUERIES[key], ORACLES[key], SF)
    assert not problems and n > 0
