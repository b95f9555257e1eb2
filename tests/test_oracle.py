"""Every registered query of the library against its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as E
from paths import SF01
from oracle_harness import compare, duck
from sluice.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    problems, n = compare(spark, key, E.queries()[key], E.oracle_sql()[key], SF01, con)
    assert not problems and n > 0, problems


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 102
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pos_ratio" in df.columns
