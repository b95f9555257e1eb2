"""Joins of bucketed tables: no exchange in the plan, and the rows of the joins that shuffle."""

import pytest

from paths import SF01
from sluice.plans.registry import QUERIES, load_all
from sluice.sources.bucketed import write_bucketed

load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("key", ["ensemble_join", "submission_join", "pool_join"])
def test_no_exchange_and_same_rows(spark, no_broadcast, key):
    plain, bucketed = QUERIES[key](spark, SF01), QUERIES[f"{key}_bucketed"](spark, SF01)
    assert "Exchange" in plan(plain) and "Exchange" not in plan(bucketed)
    assert bucketed.count() == plain.count() > 0 and bucketed.exceptAll(plain).count() == 0


def test_one_file_a_bucket_nulls_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, str(i)) for i in range(500)], "id long, v string")
    got = write_bucketed(rows.repartition(5), ["id"], 4, path=f"{tmp_path}/t")
    assert sorted(got.collect(), key=str) == sorted(rows.collect(), key=str)
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) == 4
    assert write_bucketed(rows.limit(0), ["id"], 4).count() == 0
