"""Best epoch so far and patience of runs whose metrics arrive as a stream.

The metrics of a run's epochs come late, out of order and again (an epoch that is
repeated replaces what it gave before). The state per run is its epochs and
their newest metrics; a micro-batch that changes an epoch gives that epoch and all
later ones of the run anew, as their running best may differ. What a run was
given last for an epoch is its row in the result, so that the result equals
``best_so_far`` over the newest metric of each epoch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.session import ship_package
from sluice.streaming.streams import _current, _folders, _remove

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "epoch long, auc double, best_auc double, best_epoch long, bad_epochs long, stopped boolean"


def running_best(newest: dict[int, float | None], patience: int) -> Iterator[tuple]:
    """Rows ``(epoch, auc, best_auc, best_epoch, bad_epochs, stopped)`` in the order of epochs.

    The best starts at 0 in epoch 1, and only a greater value beats it. ``bad_epochs``
    counts epochs since the last that did; a run has stopped once they reached
    ``patience``. A missing or NaN metric beats nothing.
    """
    best, at, bad, stopped = 0.0, 1, 0, False
    for epoch in sorted(newest):
        auc = newest[epoch]
        if auc is not None and auc > best:
            best, at, bad = auc, epoch, 0
        else:
            bad += 1
        stopped = stopped or bad >= patience
        yield epoch, auc, best, at, bad, stopped


class Progress(StatefulProcessor):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "epochs array<long>, at array<long>, auc array<double>")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = {}
        if self.newest.exists():  # one read and one write of the state per run and micro-batch
            newest = {e: (at, auc) for e, at, auc in zip(*self.newest.get(), strict=True)}
        changed = None
        for part in rows:
            for epoch, at, auc in zip(part["epoch"].tolist(), part["at"].tolist(), part["auc"].tolist(), strict=True):
                new = (at, None if pd.isna(auc) else auc)
                # of metrics with one time the greater counts, whichever comes first
                if epoch not in newest or _order(*new) > _order(*newest[epoch]):
                    newest[epoch] = new
                    changed = epoch if changed is None else min(changed, epoch)
        if changed is not None:
            self.newest.update((list(newest), [at for at, _ in newest.values()], [auc for _, auc in newest.values()]))
            all_rows = running_best({e: auc for e, (_, auc) in newest.items()}, self.patience)
            out = pd.DataFrame([(key[0], *r) for r in all_rows if r[0] >= changed],
                               columns=["run", "epoch", "auc", "best_auc", "best_epoch", "bad_epochs", "stopped"])
            yield out.astype({"auc": "float64"})

    def close(self) -> None:
        pass


def _order(at: int, auc: float | None) -> tuple:
    return at, auc is not None, auc if auc is not None else 0.0


def update_progress(src: DataFrame, snapshots: str, checkpoint: str, patience: int) -> None:
    """Take the metrics that have arrived in ``src`` (``run, epoch, auc, at``) into the runs' progress.

    ``at`` is the order of the metrics of one epoch (the attempt, or a time): the
    greatest counts. Rows without a run, epoch or time are left out. The state is
    keyed by run, so that runs are spread over tasks, and holds one entry per epoch
    of a run. Changed rows are written to ``snapshots/rows=<id>``, merged as the meters'
    counts are: a row is written again once for each doubling of the micro-batches.
    """
    spark = src.sparkSession
    ship_package(spark)
    rows = src.select("run", F.col("epoch").cast("long").alias("epoch"), F.col("auc").cast("double").alias("auc"), F.col("at").cast("long").alias("at"))
    run = rows.schema["run"].dataType.simpleString()
    changed = rows.dropna(subset=["run", "epoch", "at"]).groupBy("run").transformWithStateInPandas(
        Progress(patience), f"run {run}, {ROW}", outputMode="update", timeMode="none")

    def add_rows(batch_df: DataFrame, batch_id: int) -> None:
        new = batch_df.withColumn("batch", F.lit(batch_id).cast("long"))
        for i in _folders(spark, snapshots, "rows="):
            if i < batch_id and i not in _current(batch_id - 1):
                _remove(spark, f"{snapshots}/rows={i}")
        covered = [i for i in _current(batch_id - 1) if i not in _current(batch_id)]
        if covered:
            new = _newest(new.unionByName(_read(spark, snapshots, run, covered)))
        new.write.mode("overwrite").parquet(f"{snapshots}/rows={batch_id}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # the one that holds state of several columns
    try:
        q = (changed.writeStream.outputMode("update").foreachBatch(add_rows)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)


def _newest(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("run", "epoch")]
    row = F.max_by(F.struct(*others), "batch").alias("_row")
    return rows.groupBy("run", "epoch").agg(row).select("run", "epoch", "_row.*").select(*rows.columns)


def _read(spark: SparkSession, snapshots: str, run: str, batches: list[int]) -> DataFrame:
    return spark.read.schema(f"run {run}, {ROW}, batch long").parquet(*[f"{snapshots}/rows={i}" for i in batches])


def read_progress(spark: SparkSession, snapshots: str, run_type: str = "string") -> DataFrame:
    """W3 as of the last whole micro-batch: a row per run and epoch, with ``bad_epochs`` and ``stopped``."""
    done = _folders(spark, snapshots, "rows=")
    if not done:
        return spark.createDataFrame([], f"run {run_type}, {ROW}")
    return _newest(_read(spark, snapshots, run_type, _current(max(done)))).drop("batch")


def last_progress(spark: SparkSession, snapshots: str, run_type: str = "string") -> DataFrame:
    """A11 of every run: the row of its last epoch."""
    w = Window.partitionBy("run").orderBy(F.desc("epoch"))
    return read_progress(spark, snapshots, run_type).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
