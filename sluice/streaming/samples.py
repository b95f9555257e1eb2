"""Exact samples of an arriving table (M1, M6): the rows of least hash so far.

The ``n`` rows of least hash of a union are among the ``n`` of each part, so a
sample is a state that merges: every micro-batch adds its rows to the last
sample and keeps ``n`` again. Once a sample is full, rows above its greatest
hash are dropped where they are read; of ``N`` rows that arrive in even shares
about ``n * ln(N / n)`` go any further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import u32
from sluice.operators.ranking import join_groups, smallest_n
from sluice.streaming.streams import _folders, _remove


def update_sample(src: DataFrame, snapshots: str, checkpoint: str, n: int, key: str = "id", salt: str = "sample",
                  seed: int = 42, epochs: int | None = None) -> None:
    """Take what has arrived in ``src`` into the sample of ``n`` rows, or into those of ``epochs`` draws of ``n``.

    The sample is the one that ``sample_exact_n`` (with ``epochs``, ``epoch_negatives``)
    draws from all rows that ever arrived, however they were split into micro-batches.
    Micro-batch ``id`` writes it to ``snapshots/sample=<id>`` and drops what is older
    than the one before: a batch that is written again after a restart starts from the
    same sample as the first time. Keys must be unique, as they are the tie-break.
    A row with a null key is drawn like others. Arguments must stay as they are from one call to the next.
    """
    if n < 1:
        raise ValueError("a sample needs at least one row")
    groups = ["epoch"] if epochs else []

    def add_rows(batch_df: DataFrame, batch_id: int) -> None:
        spark, new = batch_df.sparkSession, batch_df
        if epochs:
            new = new.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        new = new.withColumn("_h", u32(F.col(key), salt, seed, *[F.col(g) for g in groups]))
        before = [i for i in _folders(spark, snapshots, "sample=") if i < batch_id]
        if before:
            old = spark.read.schema(new.schema).parquet(f"{snapshots}/sample={max(before)}")
            full = old.groupBy(*groups).agg(F.when(F.count(F.lit(1)) >= n, F.max("_h")).alias("_full"))
            # a row per draw
            new = join_groups(new, F.broadcast(full), groups, "left") if epochs else new.withColumn("_full", full.select("_full").scalar())
            new = old.unionByName(new.filter(F.col("_full").isNull() | (F.col("_h") <= F.col("_full"))).drop("_full"))
        smallest_n(new, n, "_h", key, groups, groups_bound=epochs).write.mode("overwrite").parquet(f"{snapshots}/sample={batch_id}")
        for i in before:
            if i != max(before):
                _remove(spark, f"{snapshots}/sample={i}")

    q = (src.writeStream.foreachBatch(add_rows)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_sample(spark: SparkSession, snapshots: str, schema: str, n: int, epochs: int | None = None, strict: bool = True) -> DataFrame:
    """The sample as of the last whole micro-batch: the source's columns (``schema``), after ``epoch`` if there are draws.

    ``strict`` fails, as ``sample_exact_n`` does, while fewer than ``n`` rows have
    arrived; otherwise all that did are returned. No rows before the first batch.
    """
    done = _folders(spark, snapshots, "sample=")
    fields = f"epoch int, {schema}" if epochs else schema
    out = spark.read.schema(fields).parquet(f"{snapshots}/sample={max(done)}") if done else spark.createDataFrame([], fields)
    if strict and out.count() < n * (epochs or 1):
        raise ValueError("sample larger than population")
    return out
