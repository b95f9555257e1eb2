"""Structured Streaming versions of scoring (ST1) and the meters (ST2).

Both read a file source (new Parquet files as they arrive), reuse the same
column expressions as the batch operators, and run with
``trigger(availableNow=True)``: every file present is processed, in as many
micro-batches as ``maxFilesPerTrigger`` allows, and the query stops. Sink and
checkpoint are the caller's paths, on shared storage: a query started again
with the same ones goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scoring import TEXT_HEAD_BIAS, TEXT_HEAD_WEIGHTS, linear_head, text_features
from sluice.functions.text import clean_text
from sluice.operators.metrics import checked_score, roc_auc_counts


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                files_per_trigger: int = 1) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)


def stream_clean_score(src: DataFrame, sink: str, checkpoint: str, key: str = "id", text_col: str = "comment_text",
                       lang_col: str | None = None, weights: Sequence[float] = TEXT_HEAD_WEIGHTS,
                       bias: float = TEXT_HEAD_BIAS) -> DataFrame:
    """ST1: clean and score arriving texts into the Parquet table ``sink``; returns it.

    Rows ``(key, clean, logit)``. The file sink's log makes each input file
    count once, also over restarts.
    """
    out = src.select(key, clean_text(F.col(text_col), lang_col).alias("clean"))
    out = out.withColumn("logit", linear_head(text_features("clean"), weights, bias))
    q = (out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return src.sparkSession.read.schema(out.schema).parquet(sink)


def binned(score: Column, bins: int) -> Column:
    """The lower edge of a score's bin; scores are clamped to [0, 1]."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.floor(s * bins) / F.lit(float(bins))


def update_meters(src: DataFrame, snapshots: str, checkpoint: str, y: Column, score: Column, loss: Column,
                  split: Column, bins: int | None = None) -> None:
    """ST2's state: class counts, loss sum and rows per (split, score), of the exact scores unless ``bins`` is given.

    The exact state is a table in ``snapshots``, and the stream itself keeps none:
    micro-batch ``id`` writes the counts of its rows, together with those of the
    batches before that it covers, to ``counts=<id>``. It covers as many as a
    Fenwick tree's node does, so that a row is written again once for each doubling
    of the batches, and few folders make the state. Folders that another covers are
    dropped in the next batch, when that one's is committed: a batch that is written
    again after a restart finds all it covers.

    With ``bins``, scores are clamped to [0, 1] and cut into bins: ``bins`` + 1 rows
    per split at most. Every micro-batch writes the complete state to a folder of its
    own, ``snapshots/batch=<id>``, and then drops the one before the last: a driver
    that dies while writing leaves the last whole snapshot, and the batch is
    written again after a restart.
    """
    s = checked_score(score, y)
    rows = src.select(split.alias("split"), y.cast("int").alias("y"), (s if bins is None else binned(s, bins)).alias("score"), loss.cast("double").alias("loss"))
    if bins is None:
        def add_counts(batch_df: DataFrame, batch_id: int) -> None:
            spark, new = batch_df.sparkSession, _counted(batch_df)
            for i in _folders(spark, snapshots, "counts="):
                if i < batch_id and i not in _current(batch_id - 1):
                    _remove(spark, f"{snapshots}/counts={i}")
            covered = [i for i in _current(batch_id - 1) if i not in _current(batch_id)]
            if covered:
                new = _merged(new.unionByName(_read_counts(spark, snapshots, covered)))
            new.write.mode("overwrite").parquet(f"{snapshots}/counts={batch_id}")

        q = (rows.writeStream.foreachBatch(add_counts)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        return
    state = _counted(rows)

    def write_snapshot(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{snapshots}/batch={batch_id}")
        _remove(batch_df.sparkSession, f"{snapshots}/batch={batch_id - 2}")

    q = (state.writeStream.outputMode("complete").foreachBatch(write_snapshot)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
        F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("n"))


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("split", "score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "loss_sum", "n")])


def _current(batch_id: int) -> list[int]:
    """The batches whose folders together hold all batches up to ``batch_id``."""
    out, i = [], batch_id + 1
    while i > 0:
        out.append(i - 1)
        i &= i - 1
    return out


def _read_counts(spark: SparkSession, snapshots: str, batches: list[int]) -> DataFrame:
    return spark.read.schema(STATE).parquet(*[f"{snapshots}/counts={i}" for i in batches])


def _folders(spark: SparkSession, snapshots: str, prefix: str) -> list[int]:
    """The numbers of the whole folders of that name."""
    fs, p = _fs(spark, snapshots)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and fs.exists(_fs(spark, f"{snapshots}/{n}/_SUCCESS")[1])]


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


STATE = "split string, score double, pos bigint, neg bigint, loss_sum double, n bigint"


def last_snapshot(spark: SparkSession, snapshots: str) -> DataFrame:
    """The meters' state as of the last whole micro-batch, a row per split and score; no rows before the first batch."""
    exact = _folders(spark, snapshots, "counts=")
    if exact:
        return _merged(_read_counts(spark, snapshots, _current(max(exact))))
    done = _folders(spark, snapshots, "batch=")
    return spark.read.schema(STATE).parquet(f"{snapshots}/batch={max(done)}") if done else spark.createDataFrame([], STATE)


def read_meters(state: DataFrame, seeds: bool = True) -> DataFrame:
    """Loss mean, rows and AUC per split: ``(split, avg_loss, n_rows, auc)``.

    ``seeds`` adds the points (0, .5) and (1, .5) that the meter starts from. The
    AUC is that of the state's scores, exact unless they are binned.
    """
    counts = state.select("split", "score", "pos", "neg")
    if seeds:
        one = F.lit(1).cast("bigint")
        seed = state.select("split").distinct().select("split", F.lit(0.5).alias("score"), one.alias("pos"), one.alias("neg"))
        counts = counts.unionByName(seed).groupBy("split", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    auc = roc_auc_counts(counts, "score", "pos", "neg", ["split"]).select(F.col("split").alias("_split"), "auc")
    loss = state.groupBy("split").agg((F.sum("loss_sum") / F.sum("n")).alias("avg_loss"), F.sum("n").cast("bigint").alias("n_rows"))
    return loss.join(auc, F.col("split").eqNullSafe(F.col("_split"))).drop("_split")
