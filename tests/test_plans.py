"""Plan-shape guards: the scale properties documented in PLANS.md, checked on
the physical plans so a change that breaks them fails a test."""

import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF01
from sluice.operators import metrics as A
from sluice.operators import sequences as SQ


def plan_of(spark, key):
    df = E.queries()[key](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def windows_without_partition(plan: str):
    # Window [...], [partition keys], [order keys]: an empty partition list means one task
    return re.findall(r"Window \[.*?\], \[\], \[", plan)


def test_flagship_prunes_columns_and_combines_map_side(spark):
    p = plan_of(spark, "label_stats_by_lang")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "source" not in re.search(r"FileScan parquet \[([^\]]*)\][^\n]*documents", p).group(1)
    assert "partial_count" in p and "partial_sum" in p


def test_sampling_sorts_only_the_cut_bin(spark):
    p = plan_of(spark, "epoch_resample")
    # every row_number window is partitioned (by epoch and hash bin)
    for w in re.findall(r"Window \[row_number\(\).*?\], \[([^\]]*)\]", p):
        assert "epoch" in w and "_bin" in w
    # the per-epoch cut (at most `epochs` rows, a parameter) is broadcast; rows do not shuffle by epoch
    assert re.search(r"BroadcastHashJoin \[[^\n]*epoch#\d+", p)


def test_dedup_collapses_duplicates_before_the_shuffle(spark):
    p = plan_of(spark, "dedup_text")
    assert "partial_min" in p
    assert not windows_without_partition(p)


def test_auc_has_no_window_over_all_rows_and_no_forced_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(spark, "roc_auc")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for w in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", p):
        assert "epoch" in w
    assert "Exchange SinglePartition" not in p and "Broadcast" not in p and "SortMergeJoin" in p


def test_auc_ranges_follow_the_scores(spark):
    # 99 % of the scores lie below 1e-5: no window partition holds more than a few percent of them
    n = 40_000
    rows = spark.range(n).select((F.col("id") % 7 == 0).cast("int").alias("y"), F.when(F.col("id") % 100 == 0, F.col("id") / n)
                                 .otherwise(F.col("id") / n * 1e-5).alias("_s"))
    sizes = [r["count"] for r in A.score_bins(rows.select("_s").distinct(), "_s", 64).groupBy("_bin").count().collect()]
    assert max(sizes) < 0.04 * n
    plain = rows.withColumn("score", F.rank().over(Window.orderBy("_s")).cast("double"))
    assert abs(A.roc_auc(rows, "y", "_s", bins=64).first().auc - A.roc_auc(plain, "y", "score", bins=3).first().auc) < 1e-12


def test_encoding_looks_up_only_what_it_keeps(spark):
    df = spark.createDataFrame([(1, "a " * 5000)], "id long, t string")
    vocab = spark.createDataFrame([("a", 4)], "token string, token_id int")
    p = SQ.encode(df, "id", "t", vocab, 192)._jdf.queryExecution().executedPlan().toString()
    assert "slice(" in p[p.rindex("Generate posexplode"):].split("\n")[0] + p[p.index("Generate posexplode"):].split("\n")[0]


def test_length_buckets_ranks_narrow_rows(spark):
    p = plan_of(spark, "length_buckets")
    assert "array<int>" not in p and "token_type_ids" not in p and "mask" not in p


def test_flagship_filter_reaches_the_scan(spark):
    p = plan_of(spark, "compose_trainset")
    assert re.search(r"PushedFilters: \[[^\]]*In\(source", p)



@pytest.mark.parametrize("key", ["compose_trainset", "shard_rows", "keep_last_partial", "minmax_scale",
                                 "loss_weight_ratio", "csv_scan_keyed", "running_auc", "build_vocab"])
def test_no_cross_joins(spark, key):
    p = plan_of(spark, key)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
