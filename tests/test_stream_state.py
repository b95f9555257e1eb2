"""Streams with a merging state: samples and the progress of runs equal the batch result after any split and a restart."""

import pytest
from pyspark.sql import functions as F
from test_streams import add_file

from paths import SF01
from sluice.operators import metrics as A
from sluice.operators import sampling as M
from sluice.sources import tables as T
from sluice.streaming import progress as P
from sluice.streaming import samples as SA
from sluice.streaming import streams as ST


def pieces(df, by, folder, tmp, stops):
    """Adds the rows a file at a time, and yields after the files of ``stops``."""
    for i in range(max(stops) + 1):
        add_file(df.filter(by == i), folder, tmp, f"f{i}")
        if i in stops:
            yield i


@pytest.mark.parametrize("uneven", [False, True])
def test_sample_equals_batch(spark, tmp_path, uneven):
    ev = T.table(spark, SF01, "events").select("event_id", "value")
    by = F.when(F.col("event_id") < 40, 0).when(F.col("event_id") % 50 == 1, 1).otherwise(2) if uneven else F.col("event_id") % 4
    stops = (0, 2) if uneven else (1, 3)
    for i in pieces(ev, by, tmp_path / "in", tmp_path, stops):
        src = ST.file_stream(spark, f"{tmp_path}/in", ev.schema)
        SA.update_sample(src, f"{tmp_path}/snap", f"{tmp_path}/ckpt", 100, key="event_id")
        arrived = ev.filter(by <= i)
        got = SA.read_sample(spark, f"{tmp_path}/snap", "event_id long, value double", 100, strict=False)
        assert sorted(got.collect()) == sorted(M.sample_exact_n(arrived, 100, key="event_id", strict=False).collect())
        if arrived.count() < 100:
            with pytest.raises(ValueError, match="larger than population"):
                SA.read_sample(spark, f"{tmp_path}/snap", "event_id long, value double", 100)
    assert got.count() == 100 and len(list((tmp_path / "snap").iterdir())) <= 2


def test_epoch_draws_equal_batch(spark, tmp_path):
    ev = T.table(spark, SF01, "events").select("event_id")
    for _ in pieces(ev, F.col("event_id") % 5, tmp_path / "in", tmp_path, (0, 2, 4)):
        src = ST.file_stream(spark, f"{tmp_path}/in", ev.schema, files_per_trigger=2)
        SA.update_sample(src, f"{tmp_path}/snap", f"{tmp_path}/ckpt", 70, key="event_id", salt="negatives", epochs=3)
    got = SA.read_sample(spark, f"{tmp_path}/snap", "event_id long", 70, epochs=3).select("epoch", "event_id")
    want = M.epoch_negatives(ev, 70, 3, "event_id").select("epoch", "event_id")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 210


def test_sample_written_again_after_a_stop(spark, tmp_path, monkeypatch):
    ev = T.table(spark, SF01, "events").select("event_id")
    real, calls = SA._remove, []

    def dies(spark, path):
        calls.append(path)
        raise RuntimeError("driver lost")  # after the batch was written, before it is committed

    folder = tmp_path / "in"

    def run():
        SA.update_sample(ST.file_stream(spark, str(folder), ev.schema), f"{tmp_path}/snap", f"{tmp_path}/ckpt", 50, key="event_id")

    for i in range(4):
        add_file(ev.filter(F.col("event_id") % 4 == i), folder, tmp_path, f"f{i}")
    monkeypatch.setattr(SA, "_remove", dies)
    with pytest.raises(Exception, match="driver lost"):
        run()
    assert len(calls) == 1
    monkeypatch.setattr(SA, "_remove", real)
    run()
    got = SA.read_sample(spark, f"{tmp_path}/snap", "event_id long", 50)
    assert sorted(got.collect()) == sorted(M.sample_exact_n(ev, 50, key="event_id").collect())


def test_empty_sample(spark, tmp_path):
    assert SA.read_sample(spark, f"{tmp_path}/none", "id long", 3, strict=False).count() == 0
    with pytest.raises(ValueError):
        SA.read_sample(spark, f"{tmp_path}/none", "id long", 3)
    with pytest.raises(ValueError):
        SA.update_sample(None, "", "", 0)


METRICS = "run string, epoch long, auc double, at long, piece int"


def test_progress_of_late_and_repeated_epochs(spark, tmp_path):
    rows = [("a", 1, 0.5, 1, 0), ("a", 3, 0.7, 1, 0), ("b", 1, None, 1, 0), ("a", 2, 0.9, 1, 1),  # epoch 2 comes late
            ("a", 2, 0.4, 2, 2), ("a", 3, 0.1, 0, 2), ("b", 2, 0.2, 1, 2), ("b", 3, 0.2, 1, 2),  # repeated: newer counts, older does not
            ("a", 4, 0.7, 1, 3), ("a", 5, float("nan"), 1, 3), (None, 1, 0.9, 1, 3), ("a", None, 0.9, 1, 3), ("c", 1, -1.0, 1, 3)]
    df = spark.createDataFrame(rows, METRICS)
    for i in pieces(df, F.col("piece"), tmp_path / "in", tmp_path, (1, 3)):
        src = ST.file_stream(spark, f"{tmp_path}/in", df.schema)
        P.update_progress(src, f"{tmp_path}/snap", f"{tmp_path}/ckpt", patience=2)
        if i == 1:
            first = {(r.run, r.epoch): (r.best_auc, r.best_epoch) for r in P.read_progress(spark, f"{tmp_path}/snap").collect()}
            assert first == {("a", 1): (0.5, 1), ("a", 2): (0.9, 2), ("a", 3): (0.9, 2), ("b", 1): (0.0, 1)}
    got = {(r.run, r.epoch): tuple(r)[3:] for r in P.read_progress(spark, f"{tmp_path}/snap").collect()}
    assert got == {("a", 1): (0.5, 1, 0, False), ("a", 2): (0.5, 1, 1, False), ("a", 3): (0.7, 3, 0, False), ("a", 4): (0.7, 3, 1, False),
                   ("a", 5): (0.7, 3, 2, True), ("b", 1): (0.0, 1, 1, False), ("b", 2): (0.2, 2, 0, False), ("b", 3): (0.2, 2, 1, False),
                   ("c", 1): (0.0, 1, 1, False)}
    last = {r.run: (r.epoch, r.best_epoch, r.stopped) for r in P.last_progress(spark, f"{tmp_path}/snap").collect()}
    assert last == {"a": (5, 3, True), "b": (3, 2, False), "c": (1, 1, False)}


def test_progress_equals_batch(spark, tmp_path):
    ev = T.table(spark, SF01, "events")
    df = ev.filter("event_id < 3000").select(
        (F.col("user_id") % 40).alias("run"), (F.xxhash64("event_id") % 12 + 12).alias("epoch"), F.round(F.col("value") / 500, 2).alias("auc"),
        F.xxhash64("event_id", F.lit(3)).alias("at"), (F.col("event_id") % 3).cast("int").alias("piece"))
    for _ in pieces(df, F.col("piece"), tmp_path / "in", tmp_path, (0, 2)):
        P.update_progress(ST.file_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/snap", f"{tmp_path}/ckpt", patience=3)
    newest = df.groupBy("run", "epoch").agg(F.max_by("auc", "at").alias("auc"))
    want = A.best_so_far(newest, group_cols=["run"]).select("run", "epoch", "best_auc", F.col("best_epoch").cast("long"))
    got = P.read_progress(spark, f"{tmp_path}/snap", "long").select("run", "epoch", "best_auc", "best_epoch")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 500
    best = {r.run: r.best_epoch for r in A.best_epoch(newest, group_cols=["run"]).collect()}
    assert {r.run: r.best_epoch for r in P.last_progress(spark, f"{tmp_path}/snap", "long").collect()} == best
