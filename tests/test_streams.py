"""Streams: equal to the batch result, bounded state, and resumed after a stop."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from sluice.functions.text import clean_text
from sluice.operators import metrics as A
from sluice.sources import tables as T
from sluice.streaming import streams as ST


def add_file(df, folder, tmp, name):
    """One Parquet file of the rows, put into the folder that a stream reads."""
    df.coalesce(1).write.parquet(f"{tmp}/{name}")
    (part,) = (tmp / name).glob("part-*.parquet")
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.parquet").write_bytes(part.read_bytes())


def test_scores_resume_where_they_stopped(spark, tmp_path):
    docs = T.table(spark, SF01, "documents")
    folder = tmp_path / "in"

    def run():
        src = ST.file_stream(spark, str(folder), docs.schema)
        return ST.stream_clean_score(src, f"{tmp_path}/sink", f"{tmp_path}/ckpt", "doc_id", "text", "lang")

    add_file(docs.filter("doc_id % 3 = 0"), folder, tmp_path, "a")
    assert run().count() == docs.filter("doc_id % 3 = 0").count()
    add_file(docs.filter("doc_id % 3 = 1"), folder, tmp_path, "b")
    add_file(docs.filter("doc_id % 3 = 2"), folder, tmp_path, "c")
    out = run()  # only the new files are read: the old rows are there once
    batch = docs.select("doc_id", clean_text("text", "lang").alias("clean"))
    assert out.count() == batch.count() and out.select("doc_id", "clean").exceptAll(batch).count() == 0


def test_meters_resume_and_equal_batch(spark, tmp_path):
    ev = T.table(spark, SF01, "events")
    folder = tmp_path / "in"
    split = F.when(F.col("event_id") % 2 == 0, "even")  # the others have a null split

    def run():
        src = ST.file_stream(spark, str(folder), ev.schema)
        ST.update_meters(src, f"{tmp_path}/snap", f"{tmp_path}/ckpt", F.col("event_type") == "error", F.col("value") / 500.0, F.col("value"), split, bins=256)
        return ST.last_snapshot(spark, f"{tmp_path}/snap")

    assert ST.last_snapshot(spark, f"{tmp_path}/snap").count() == 0
    for i in range(4):
        add_file(ev.filter(F.col("event_id") % 4 == i), folder, tmp_path, f"f{i}")
        if i in (0, 3):
            state = run()
    assert state.count() <= 2 * 257
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == ["batch=2", "batch=3"]
    rows = ev.select(split.alias("split"), (F.col("event_type") == "error").cast("int").alias("y"), ST.binned(F.col("value") / 500.0, 256).alias("score"), "value")
    auc = {r.split: r.auc for r in A.roc_auc(rows, "y", "score", ["split"]).collect()}
    want = {r.split: (r.n, r.m) for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
    got = {r.split: r for r in ST.read_meters(state, seeds=False).collect()}
    assert set(got) == {"even", None}
    for k, r in got.items():
        assert (r.n_rows, r.avg_loss, r.auc) == (want[k][0], pytest.approx(want[k][1]), pytest.approx(auc[k]))


def test_meters_are_exact_for_any_scores(spark, tmp_path):
    # scores far below one bin's width, and logits outside [0, 1]; seven batches over a restart
    rows = spark.range(2100).select(
        (F.col("id") % 7).alias("part"), (F.xxhash64("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("loss"),
        F.when(F.col("id") % 2 == 0, "tiny").alias("split"), (F.abs(F.xxhash64("id", F.lit(1)) % 997) + 300 * (F.xxhash64("id") % 3 == 0).cast("int")).alias("k"))
    rows = rows.withColumn("score", F.when(F.col("split") == "tiny", F.col("k") * 1e-9).otherwise(F.col("k") - 500.0)).drop("k")
    folder = tmp_path / "in"
    want = {r.split: r.auc for r in A.roc_auc(rows, "y", "score", ["split"]).collect()}
    for i in range(7):
        add_file(rows.filter(F.col("part") == i), folder, tmp_path, f"f{i}")
        if i in (0, 4, 6):
            src = ST.file_stream(spark, str(folder), rows.schema)
            ST.update_meters(src, f"{tmp_path}/snap", f"{tmp_path}/ckpt", F.col("y"), F.col("score"), F.col("loss"), F.col("split"))
    state = ST.last_snapshot(spark, f"{tmp_path}/snap")
    assert state.count() == rows.select("split", "score").distinct().count()
    got = {r.split: r for r in ST.read_meters(state, seeds=False).collect()}
    assert set(got) == {"tiny", None} and all(0.55 < a < 0.95 for a in want.values())
    for k, r in got.items():
        assert (r.n_rows, r.avg_loss, r.auc) == (1050, pytest.approx(1049 if k else 1050), pytest.approx(want[k], abs=1e-12))
    assert len(list((tmp_path / "snap").iterdir())) <= 4
