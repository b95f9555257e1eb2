"""Queries for metrics and meters: A3, A5-A11, W1-W3, F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import metrics as A
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

MR = S.METRIC_ROWS
# epochs of the metric stream: 25 steps each
EPOCH_STEPS = 25
MR_EPOCH = f"(SELECT *, step // {EPOCH_STEPS} + 1 AS epoch FROM {MR} m)"
# logit view of the metric rows: x = (value - 250) / 50, weight .9 for negatives
LOGITS = f"""(SELECT event_id, step, y, (loss - 250.0) / 50.0 AS x,
                CASE WHEN y = 0 THEN 0.9 ELSE 1.0 END AS w FROM {MR} m)"""


def _metric_rows(spark, sf_dir):
    return T.metric_rows(spark, sf_dir).withColumn("epoch", (F.col("step") / EPOCH_STEPS).cast("bigint") + 1)


def _logits(spark, sf_dir):
    m = T.metric_rows(spark, sf_dir)
    return m.select("event_id", "step", "y", ((F.col("loss") - 250.0) / 50.0).alias("x"),
                    F.when(F.col("y") == 0, 0.9).otherwise(1.0).alias("w"))


@register("minmax_scale", sql=f"""
SELECT event_id, round((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 9) AS scaled
FROM {MR} m
""")
def minmax_scale(spark, sf_dir):
    m = T.metric_rows(spark, sf_dir)
    return A.minmax_scale(m, "score", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


def _auc_sql(table: str, group: str) -> str:
    gsel = f"{group}, " if group else ""
    gpart = f"PARTITION BY {group} " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    return f"""
WITH r AS (SELECT {gsel} y, score,
             (rank() OVER ({gpart}ORDER BY score) + count(*) OVER ({gpart.replace('PARTITION BY', 'PARTITION BY score,') if group else 'PARTITION BY score'}) - 1
              + rank() OVER ({gpart}ORDER BY score)) / 2.0 AS avg_rank
           FROM {table} t)
SELECT {gsel} CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_neg,
       round((sum(avg_rank) FILTER (WHERE y = 1)
         - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
         / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 9) AS auc
FROM r {gby}
"""


@register("roc_auc", sql=_auc_sql(MR_EPOCH, "epoch"))
def roc_auc(spark, sf_dir):
    m = _metric_rows(spark, sf_dir)
    out = A.roc_auc(m, "y", "score", ["epoch"])
    return out.select("epoch", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@register("weighted_bce", sql=f"""
SELECT step, round(avg(w * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))), 9) AS loss
FROM {LOGITS} l GROUP BY step
""")
def weighted_bce(spark, sf_dir):
    out = A.weighted_bce(_logits(spark, sf_dir), "x", "y", "w", ["step"])
    return out.select("step", F.round("loss", 9).alias("loss"))


@register("focal_loss", sql=f"""
SELECT step, round(0.5 * pow(1 - exp(-b), 1.5) * b, 9) AS loss FROM (
  SELECT step, avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS b FROM {LOGITS} l GROUP BY step) q
""")
def focal_loss(spark, sf_dir):
    out = A.focal_loss(_logits(spark, sf_dir), "x", "y", ["step"])
    return out.select("step", F.round("loss", 9).alias("loss"))


@register("label_smoothing_loss", sql="""
WITH e AS (SELECT vec_id // 16 AS batch, label % len(embedding) AS target,
                  list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10) AS x FROM embeddings),
m AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS lse FROM e),
l AS (SELECT batch, lse - x[target + 1] AS nll, lse - list_sum(x) / len(x) AS mean_neg FROM m)
SELECT batch, round(avg(0.9 * nll + 0.1 * mean_neg), 9) AS smoothed, round(avg(nll), 9) AS plain FROM l GROUP BY batch
""")
def label_smoothing_loss(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    x = e.select((F.col("vec_id") / 16).cast("bigint").alias("batch"), (F.col("label") % F.size("embedding")).alias("target"),
                 F.transform("embedding", lambda v: v.cast("double") * 10).alias("logits"))
    out = A.label_smoothing_loss(x, "logits", "target", ["batch"])
    return out.select("batch", F.round("smoothed", 9).alias("smoothed"), F.round("plain", 9).alias("plain"))


POOL_SQL = """(SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean_v, round(max(CAST(v AS DOUBLE)), 6) AS max_v
FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS dim FROM embeddings) e
GROUP BY label, dim)"""


@register("pool_mean_max", sql=f"SELECT * FROM {POOL_SQL} p")
def pool_mean_max(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    out = A.pool_mean_max_long(e, "label", "embedding")
    return out.select("label", "dim", F.round("mean_v", 6).alias("mean_v"), F.round("max_v", 6).alias("max_v"))


@register("pool_mean_max_vector", sql=f"""
SELECT label, list_concat(list(mean_v ORDER BY dim), list(max_v ORDER BY dim)) AS pooled FROM {POOL_SQL} p GROUP BY label
""")
def pool_mean_max_vector(spark, sf_dir):
    out = A.pool_mean_max(T.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", F.transform("pooled", lambda v: F.round(v, 6)).alias("pooled"))


@register("average_meter", sql=f"""
SELECT event_type AS split, round(sum(value * 1) / sum(1), 9) AS avg, CAST(count(*) AS BIGINT) AS count
FROM events GROUP BY event_type
""")
def average_meter(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), "value", F.lit(1).alias("n"))
    out = A.average_meter(ev, "value", "n", ["split"])
    return out.select("split", F.round("avg", 9).alias("avg"), "count")


def _epoch_auc(spark, sf_dir):
    return A.roc_auc(_metric_rows(spark, sf_dir), "y", "score", ["epoch"])


_EPOCH_AUC_SQL = f"(SELECT epoch, auc FROM ({_auc_sql(MR_EPOCH, 'epoch')}) z)"


@register("best_epoch", sql=f"""
SELECT CAST(CASE WHEN max(auc) > 0 THEN arg_max(epoch, auc * 1000000 - epoch * 1e-6) ELSE 1 END AS INTEGER) AS best_epoch,
       round(greatest(max(auc), 0), 9) AS best_auc
FROM {_EPOCH_AUC_SQL} a
""")
def best_epoch(spark, sf_dir):
    out = A.best_epoch(_epoch_auc(spark, sf_dir).withColumn("auc", F.round("auc", 9)))
    return out.select("best_epoch", F.round("best_auc", 9).alias("best_auc"))


@register("best_so_far", sql=f"""
WITH a AS (SELECT epoch, auc FROM {_EPOCH_AUC_SQL} q),
     b AS (SELECT x.epoch, x.auc, max(y.auc) AS best FROM a x JOIN a y ON y.epoch <= x.epoch GROUP BY x.epoch, x.auc)
SELECT b.epoch, b.auc, CASE WHEN best > 0 THEN best ELSE 0.0 END AS best_auc,
       CAST(CASE WHEN best > 0 THEN (SELECT min(epoch) FROM a WHERE a.auc = b.best AND a.epoch <= b.epoch) ELSE 1 END AS INTEGER) AS best_epoch
FROM b
""")
def best_so_far(spark, sf_dir):
    a = _epoch_auc(spark, sf_dir).select("epoch", F.round("auc", 9).alias("auc"))
    return A.best_so_far(a)


@register("running_loss", sql=f"""
SELECT event_type AS split, step,
       round(sum(sum(value)) OVER (PARTITION BY event_type ORDER BY step) / sum(count(*)) OVER (PARTITION BY event_type ORDER BY step), 9) AS avg_loss
FROM (SELECT event_type, event_id // 100 AS step, value FROM events) e GROUP BY event_type, step
""")
def running_loss(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("split"), F.expr("event_id div 100").alias("step"), "value", F.lit(1).alias("n"))
    out = A.running_loss(ev, "value", "n", "step", ["split"])
    return out.select("split", "step", F.round("avg_loss", 9).alias("avg_loss"))


@register("every_nth_step", sql=f"""
SELECT * FROM (
SELECT event_type AS split, step,
       round(sum(sum(value)) OVER (PARTITION BY event_type ORDER BY step) / sum(count(*)) OVER (PARTITION BY event_type ORDER BY step), 9) AS avg_loss
FROM (SELECT event_type, event_id // 100 AS step, value FROM events) e GROUP BY event_type, step) r
WHERE step % 10 = 0
""")
def every_nth_step(spark, sf_dir):
    return running_loss(spark, sf_dir).filter(F.col("step") % 10 == 0)


@register("running_auc", sql=f"""
WITH r AS (SELECT step, y, score FROM {MR} m UNION ALL SELECT -1, 0, 0.5 UNION ALL SELECT -1, 1, 0.5),
     pairs AS (SELECT greatest(p.step, q.step) AS t,
                      sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS d
               FROM r p JOIN r q ON p.y = 1 AND q.y = 0 GROUP BY 1),
     counts AS (SELECT step AS t, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM r GROUP BY step),
     per AS (SELECT c.t, coalesce(p.d, 0) AS d, c.np, c.nn FROM counts c LEFT JOIN pairs p ON p.t = c.t)
SELECT step, auc FROM (
  SELECT t AS step, round(sum(d) OVER (ORDER BY t) / (sum(np) OVER (ORDER BY t) * sum(nn) OVER (ORDER BY t)), 9) AS auc FROM per) z
WHERE step >= 0
""")
def running_auc(spark, sf_dir):
    m = T.metric_rows(spark, sf_dir)
    out = A.running_auc(m, "y", "score", "step")
    return out.select("step", F.round("auc", 9).alias("auc"))
