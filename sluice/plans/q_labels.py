"""Queries for label work: L1-L6, A1, A2, A12, P6, P7 and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import labels as L
from sluice.functions.text import clean_text
from sluice.operators.labels import batch_count, label_counts, loss_weight, row_count
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

C = S.COMMENTS


@register("label_stats_by_lang", sql=f"""
SELECT lang,
       CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS n0,
       CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS n1,
       CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE toxic = 0) + count(*) FILTER (WHERE toxic = 1), 0) AS pos_ratio,
       round(sum(CASE WHEN toxic = 0 THEN 0.9 ELSE toxic END), 6) AS sum_weight,
       CAST(sum(length({S.clean_text('comment_text', 'lang')})) AS BIGINT) AS clean_chars
FROM {C} c GROUP BY lang
""")
def label_stats_by_lang(spark, sf_dir):
    """Flagship: join -> clean_text -> loss weight -> per-language label stats."""
    c = T.comments(spark, sf_dir).withColumn("clean", clean_text("comment_text", "lang"))
    w = loss_weight(c, mode="constant")
    stats = w.groupBy("lang").agg(
        F.count_if(F.col("toxic") == 0).alias("n0"),
        F.count_if(F.col("toxic") == 1).alias("n1"),
        F.round(F.sum("weight"), 6).alias("sum_weight"),
        F.sum(F.length("clean")).cast("bigint").alias("clean_chars"))
    return stats.select("lang", "n0", "n1",
                        F.try_divide(F.col("n1").cast("double"), F.col("n0") + F.col("n1")).alias("pos_ratio"),
                        "sum_weight", "clean_chars")


SOFT2 = S.soft_set2()


@register("label_binarise", sql=f"""
SELECT id, toxic, CAST(coalesce(toxic >= 0.95, false) AS INTEGER) AS label FROM {SOFT2} s
""")
def label_binarise(spark, sf_dir):
    s = T.soft_set2(spark, sf_dir)
    return s.select("id", "toxic", L.binarise("toxic").alias("label"))


@register("label_floor", sql=f"""
SELECT id, CASE WHEN toxic >= 0.95 THEN toxic ELSE 0.0 END AS toxic FROM {SOFT2} s
""")
def label_floor(spark, sf_dir):
    s = T.soft_set2(spark, sf_dir)
    return s.select("id", L.floor_below("toxic").alias("toxic"))


@register("label_round", sql=f"""
SELECT id, toxic * 2.5 AS raw, CAST(round_even(toxic * 2.5, 0) AS INTEGER) AS label FROM {SOFT2} s
""")
def label_round(spark, sf_dir):
    # soft labels scaled so that exact .5 cases (0.2 * 2.5, 0.6 * 2.5 ...) occur
    s = T.soft_set2(spark, sf_dir).withColumn("raw", F.col("toxic") * 2.5)
    return s.select("id", "raw", L.round_half_even("raw").alias("label"))


@register("target_threshold", sql=f"""
SELECT id, toxic >= 0.95 AS target FROM {SOFT2} s
""")
def target_threshold(spark, sf_dir):
    s = T.soft_set2(spark, sf_dir)
    return s.select("id", L.at_least("toxic").alias("target"))


@register("class_key", sql=f"""
SELECT concat(CAST(CAST(toxic AS INTEGER) AS VARCHAR), lang) AS class_key, count(*) AS n
FROM {C} c GROUP BY 1
""")
def class_key(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    return (c.select(L.class_key(F.col("toxic").cast("int"), "lang").alias("class_key"))
            .groupBy("class_key").agg(F.count(F.lit(1)).alias("n")))


@register("loss_weight", sql=f"""
SELECT id, CASE WHEN toxic = 0 THEN 0.9 ELSE toxic END AS weight FROM {SOFT2} s
""")
def loss_weight_q(spark, sf_dir):
    s = T.soft_set2(spark, sf_dir)
    return loss_weight(s, mode="constant").select("id", "weight")


def _ratio_sql(t):
    return (f"(SELECT CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) / nullif(count(*) FILTER "
            f"(WHERE toxic = 0) + count(*) FILTER (WHERE toxic = 1), 0) AS r FROM {t} x)")


@register("loss_weight_ratio", sql=f"""
SELECT id, round(CASE WHEN toxic = 0 THEN (SELECT r FROM {_ratio_sql(S.SET1)} a) / (SELECT r FROM {_ratio_sql(S.VALID)} b)
                ELSE toxic END, 9) AS weight
FROM {S.SET1} s
""")
def loss_weight_ratio(spark, sf_dir):
    tr = T.set1(spark, sf_dir)
    va = T.valid(spark, sf_dir)
    out = loss_weight(tr, va, mode="ratio")
    return out.select("id", F.round("weight", 9).alias("weight"))


@register("loss_weight_off", sql=f"SELECT id, 1.0::DOUBLE AS weight FROM {SOFT2} s")
def loss_weight_off(spark, sf_dir):
    return loss_weight(T.soft_set2(spark, sf_dir), mode="off").select("id", "weight")


@register("label_stats", sql=f"""
SELECT split, CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS n0,
       CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS n1,
       CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE toxic = 0) + count(*) FILTER (WHERE toxic = 1), 0) AS pos_ratio
FROM (SELECT 'train' AS split, toxic FROM {SOFT2} a UNION ALL SELECT 'valid', toxic FROM {S.VALID} b) u
GROUP BY split
""")
def label_stats(spark, sf_dir):
    tr = T.soft_set2(spark, sf_dir).select(F.lit("train").alias("split"), "toxic")
    va = T.valid(spark, sf_dir).select(F.lit("valid").alias("split"), "toxic")
    out = label_counts(tr.unionByName(va), ["split"])
    return out.select("split", "n0", "n1", F.col("pos_ratio").cast("double").alias("pos_ratio"))


@register("row_count", sql=f"SELECT count(*) AS n_rows FROM {C} c")
def row_count_q(spark, sf_dir):
    return row_count(T.comments(spark, sf_dir))


@register("batch_count", sql=f"""
SELECT count(*) AS n_rows, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches,
       CAST(floor(ceil(count(*) / 16.0) * 3 / 2) AS BIGINT) AS n_steps
FROM {C} c
""")
def batch_count_q(spark, sf_dir):
    return batch_count(T.comments(spark, sf_dir), batch_size=16, epochs=3, shards=2)


@register("target_pair", sql=f"""
SELECT id, [toxic, CASE WHEN toxic = 0 THEN 0.9 ELSE toxic END] AS targets FROM {C} c
""")
def target_pair(spark, sf_dir):
    w = loss_weight(T.comments(spark, sf_dir), mode="constant")
    return w.select("id", L.target_pair("toxic", "weight").alias("targets"))


@register("one_hot", sql=f"""
SELECT id, [CAST(CAST(toxic AS INTEGER) = 0 AS FLOAT), CAST(CAST(toxic AS INTEGER) = 1 AS FLOAT)] AS target
FROM {C} c
""")
def one_hot(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    return c.select("id", L.one_hot(F.col("toxic").cast("int"), 2).alias("target"))
