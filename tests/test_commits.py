"""Sinks that a second run completes: parts by input file, and the metric log."""

import pytest
from pyspark.sql import functions as F

from sluice.sources import commits as C


def rows(files):
    return {r.id: r.x for r in files.collect()}


def test_a_killed_run_is_completed(spark, tmp_path):
    spark.range(1000).repartition(8).write.parquet(f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in")
    bad = F.lit(500)

    def fails(df):
        return df.select("id", F.when(F.col("id") == bad, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id") * 2).alias("x"))

    with pytest.raises(Exception, match="lost"):
        C.score_files(files, fails, f"{tmp_path}/out", wave=1)
    done = len(C.Store(spark, str(tmp_path)).names(f"{tmp_path}/out/_manifest"))
    before = C.scored_rows(spark, f"{tmp_path}/out", "id long, x long").count() if done else 0
    # parts without a record, as a job leaves that dies between its commit and the record
    spark.createDataFrame([(-1, -1, "stray")], "id long, x long, split string").write.mode("append").partitionBy("split").parquet(f"{tmp_path}/out/parts")
    seen = spark.sparkContext.accumulator(0)

    def works(df):
        seen.add(1)
        return df.select("id", (F.col("id") * 2).alias("x"))

    assert C.score_files(files, works, f"{tmp_path}/out", wave=3) == 8 - done == seen.value
    got = C.scored_rows(spark, f"{tmp_path}/out", "id long, x long")
    assert got.count() == 1000 > before and {r.id: r.x for r in got.collect()} == {i: 2 * i for i in range(1000)}
    assert C.score_files(files, works, f"{tmp_path}/out") == 0
    # a new file is scored, the others are not
    spark.range(1000, 1010).write.mode("append").parquet(f"{tmp_path}/in")
    more = C.score_files(spark.read.parquet(f"{tmp_path}/in"), works, f"{tmp_path}/out")
    assert more == len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) - 8
    assert C.scored_rows(spark, f"{tmp_path}/out", "id long, x long").count() == 1010


def test_a_repeated_append_leaves_one_row(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run string, epoch long, split string, loss double"
    one = spark.createDataFrame([("a", 1, "train", 0.5), ("a", 2, "train", 0.4)], schema)
    for _ in range(2):
        C.append_log(one, path, ["run", "epoch", "split"])
    C.append_log(spark.createDataFrame([("a", 2, "valid", 0.9), ("b", 1, "train", 0.7), ("a", 2, "train", 0.3)], schema), path, ["run", "epoch", "split"])
    got = sorted(tuple(r) for r in C.read_log(spark, path, schema).select("run", "epoch", "split", "loss").collect())
    assert got == [("a", 1, "train", 0.5), ("a", 2, "train", 0.3), ("a", 2, "valid", 0.9), ("b", 1, "train", 0.7)]
    with pytest.raises(ValueError):
        C.append_log(one.unionByName(one), path, ["run", "epoch", "split"])


def test_the_log_has_a_file_for_each_run_and_split_not_for_each_epoch(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run string, epoch long, split string, loss double"
    for split, first in (("train", 0), ("valid", 0), ("train", 0), ("train", 150)):
        rows = spark.createDataFrame([("a", e, split, float(e + first)) for e in range(first, first + 200)] + [("a", None, split, 0.5 + first)], schema)
        C.append_log(rows, path, ["run", "epoch", "split"])
    got = {(r.split, r.epoch): r.loss for r in C.read_log(spark, path, schema).collect()}
    want = {(s, e): float(e) for s, n in (("train", 150), ("valid", 200)) for e in range(n)} | {("train", e): float(e + 150) for e in range(150, 350)}
    assert got == want | {("train", None): 150.5, ("valid", None): 0.5}
    assert C.read_log(spark, path, schema).count() == len(got) and len(spark.read.schema(schema).parquet(path).inputFiles()) == 2
