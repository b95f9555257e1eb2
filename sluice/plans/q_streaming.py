"""Queries for Structured Streaming: ST1, ST2, M1, M6, A11 and W3 (the stream result equals the batch SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.plans import sqltext as S
from sluice.plans.q_scoring import _text_logit_sql
from sluice.plans.registry import register
from sluice.session import scratch_path
from sluice.sources import tables as T
from sluice.streaming import progress as P
from sluice.streaming import samples as SA
from sluice.streaming import streams as ST

SAMPLE_N, DRAWS = 500, 3
# epochs of a run of events, and bad ones in a row after which it stops
RUN_EPOCHS, PATIENCE = 10, 3


def _stream(spark, sf_dir, name):
    return ST.file_stream(spark, sf_dir, T.table(spark, sf_dir, name).schema, glob=f"{name}.parquet")


@register("stream_clean_score", sql=f"""
SELECT doc_id AS id, {S.clean_text('text', 'lang')} AS clean, round({_text_logit_sql(S.clean_text('text', 'lang'))}, 9) AS logit
FROM documents
""")
def stream_clean_score(spark, sf_dir):
    src = _stream(spark, sf_dir, "documents")
    sink = scratch_path(spark, "st1")
    out = ST.stream_clean_score(src, f"{sink}/rows", f"{sink}/checkpoint", "doc_id", "text", "lang")
    return out.select(F.col("doc_id").alias("id"), "clean", F.round("logit", 9).alias("logit"))


@register("stream_meters", sql="""
WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, CAST(event_type = 'error' AS INTEGER) AS y,
                  value / 500.0 AS score, value FROM events),
r AS (SELECT split, y, score FROM e
      UNION ALL SELECT DISTINCT split, 0, 0.5 FROM e UNION ALL SELECT DISTINCT split, 1, 0.5 FROM e),
rk AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS ar FROM r),
a AS (SELECT split, round((sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc FROM rk GROUP BY split)
SELECT split, round(avg(value), 9) AS avg_loss, count(*) AS n_rows, any_value(auc) AS auc FROM e JOIN a USING (split) GROUP BY split
""")
def stream_meters(spark, sf_dir):
    src = _stream(spark, sf_dir, "events")
    state = scratch_path(spark, "st2")
    ST.update_meters(src, f"{state}/snapshots", f"{state}/checkpoint", F.col("event_type") == "error", F.col("value") / 500.0,
                     F.col("value"), F.when(F.col("event_id") % 5 == 0, "valid").otherwise("train"))
    out = ST.read_meters(ST.last_snapshot(spark, f"{state}/snapshots"))
    return out.select("split", F.round("avg_loss", 9).alias("avg_loss"), "n_rows", F.round("auc", 9).alias("auc"))


@register("stream_sample", sql=f"""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {S.sql_u32('event_id', 'sample')}, event_id) AS rn FROM events) s
WHERE rn <= {SAMPLE_N}
""")
def stream_sample(spark, sf_dir):
    state = scratch_path(spark, "m1")
    SA.update_sample(_stream(spark, sf_dir, "events").select("event_id"), f"{state}/snapshots", f"{state}/checkpoint", SAMPLE_N, key="event_id")
    return SA.read_sample(spark, f"{state}/snapshots", "event_id long", SAMPLE_N)


@register("stream_epoch_negatives", sql=f"""
SELECT epoch, event_id FROM (
  SELECT epoch, event_id, row_number() OVER (PARTITION BY epoch ORDER BY {S.sql_u32('event_id', 'negatives', 42, 'epoch')}, event_id) AS rn
  FROM events, range(1, {DRAWS + 1}) r(epoch) WHERE event_type <> 'error') s
WHERE rn <= {SAMPLE_N}
""")
def stream_epoch_negatives(spark, sf_dir):
    state = scratch_path(spark, "m6")
    negatives = _stream(spark, sf_dir, "events").filter("event_type <> 'error'").select("event_id")
    SA.update_sample(negatives, f"{state}/snapshots", f"{state}/checkpoint", SAMPLE_N, key="event_id", salt="negatives", epochs=DRAWS)
    out = SA.read_sample(spark, f"{state}/snapshots", "event_id long", SAMPLE_N, epochs=DRAWS)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "event_id")


@register("stream_best_epoch", sql=f"""
WITH m AS (SELECT user_id AS run, event_id % {RUN_EPOCHS} + 1 AS epoch, arg_max(round(value / 500.0, 3), event_id) AS auc
           FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
w AS (SELECT *, greatest(max(auc) OVER p, 0) AS best_auc, auc > greatest(coalesce(max(auc) OVER before, 0), 0) AS better FROM m
      WINDOW p AS (PARTITION BY run ORDER BY epoch), before AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER p AS best_at, count(*) OVER p AS k FROM w WINDOW p AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, k - max(CASE WHEN better THEN k ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS bad_epochs FROM e)
SELECT run, epoch, auc, best_auc, coalesce(best_at, 1) AS best_epoch, bad_epochs,
       max(bad_epochs) OVER (PARTITION BY run ORDER BY epoch) >= {PATIENCE} AS stopped FROM b
""")
def stream_best_epoch(spark, sf_dir):
    ev = _stream(spark, sf_dir, "events").filter("user_id is not null")
    metrics = ev.select(F.col("user_id").alias("run"), (F.col("event_id") % RUN_EPOCHS + 1).alias("epoch"),
                        F.round(F.col("value") / 500.0, 3).alias("auc"), F.col("event_id").alias("at"))
    state = scratch_path(spark, "a11")
    P.update_progress(metrics, f"{state}/snapshots", f"{state}/checkpoint", patience=PATIENCE)
    return P.read_progress(spark, f"{state}/snapshots", "long")
