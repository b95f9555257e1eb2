"""Queries for J1, J2 and J3 over bucketed tables: the same rows as the joins that shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import augment as G
from sluice.operators import scoring as R
from sluice.plans.q_augment import _pool
from sluice.plans.q_scoring import VIEWS, _long_scores, _template
from sluice.plans.registry import ORACLES, register
from sluice.sources import tables as T
from sluice.sources.bucketed import write_bucketed


def _buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@register("ensemble_join_bucketed", sql=ORACLES["ensemble_join"])
def ensemble_join_bucketed(spark, sf_dir):
    scores = write_bucketed(_long_scores(spark, sf_dir), ["id"], _buckets(spark))
    return R.ensemble_join(scores, "id", VIEWS).select("id", *[F.round(f"p_{v}", 9).alias(f"p_{v}") for v in VIEWS])


@register("submission_join_bucketed", sql=ORACLES["submission_join"])
def submission_join_bucketed(spark, sf_dir):
    scores = write_bucketed(_long_scores(spark, sf_dir), ["id"], _buckets(spark))
    template = write_bucketed(_template(spark, sf_dir), ["id"], _buckets(spark))
    out = R.submission_join(template, R.ensemble_mean(scores, "id"), "id", "toxic")
    return out.select("id", "lang", F.round("toxic", 9).alias("toxic"))


@register("pool_join_bucketed", sql=ORACLES["pool_join"])
def pool_join_bucketed(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    draws = write_bucketed(G.draw_slots(T.comments(spark, sf_dir), "id", "toxic", pool), ["cls", "idx"], _buckets(spark))
    j = G.pool_join(draws, write_bucketed(pool, ["cls", "idx"], _buckets(spark)))
    return j.select("id", F.col("slot").cast("int").alias("slot"), "cls", "idx", "pool_text")
