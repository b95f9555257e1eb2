"""Queries for sampling, ordering, sharding (M1-M7, M9, M10, B2) and set ops."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.labels import target_pair
from sluice.operators import sampling as M
from sluice.operators.labels import loss_weight
from sluice.operators.sets import combine_train_valid, dedup_text, union_sources
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

# Negatives drawn per composition on the driver tables (the reference's
# 100,000 is larger than the labelled sample at these scale factors).
N_NEG = 100
SOFT2 = S.soft_set2()


def _first_n_sql(table_sql: str, n: int, h_sql: str, key: str = "id", part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    return (f"(SELECT * FROM (SELECT *, row_number() OVER ({pb}ORDER BY {h_sql}, {key}) AS _rn "
            f"FROM {table_sql} z) y WHERE _rn <= {n})")


@register("sample_exact_n", sql=f"""
SELECT event_id FROM {_first_n_sql('events', 500, S.sql_u32('event_id', 'sample'), 'event_id')} s
""")
def sample_exact_n(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select("event_id")
    return M.sample_exact_n(ev, 500, key="event_id")


@register("shuffle_rows", sql=f"SELECT id, {S.sql_u32('id', 'shuffle')} AS ord FROM {S.COMMENTS} c")
def shuffle_rows(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return M.shuffle_rows(T.comments(spark, sf_dir), num_partitions=parts).select("id", "ord")


@register("shuffle_head", sql=f"""
SELECT id, ord FROM {_first_n_sql(f"(SELECT doc_id AS id, {S.sql_u32('doc_id', 'shuffle')} AS ord FROM documents)", 2000, 'ord')} s
""")
def shuffle_head(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return M.shuffle_head(d, 2000).select("id", "ord")


# set2 as the training table has it: labels below the threshold are 0 from the load on
S2_FLOOR = f"(SELECT id, CASE WHEN toxic >= 0.95 THEN toxic ELSE 0.0 END AS toxic FROM {SOFT2} w)"


@register("compose_trainset", sql=f"""
SELECT id, toxic, 'set1' AS part FROM {S.SET1} a
UNION ALL SELECT id, toxic, 'set2_pos' FROM {S2_FLOOR} b WHERE toxic > 0
UNION ALL SELECT id, toxic, 'set2_neg' FROM {_first_n_sql(f"(SELECT * FROM {S2_FLOOR} q WHERE toxic = 0)", N_NEG, S.sql_u32('id', 'negatives'))} c
""")
def compose_trainset(spark, sf_dir, n_negatives: int = N_NEG):
    return M.compose_trainset(T.set1(spark, sf_dir), T.soft_set2(spark, sf_dir), n_negatives, "floor").select("id", "toxic", "part")


_TRAIN_PLAN_PARTS = f"""
  SELECT id, toxic, 'train' AS part FROM (
    SELECT id, toxic FROM {S.SET1} a
    UNION ALL SELECT id, 1.0 FROM {S2_FLOOR} b WHERE toxic > 0
    UNION ALL SELECT id, toxic FROM {_first_n_sql(f"(SELECT * FROM {S2_FLOOR} q WHERE toxic = 0)", N_NEG, S.sql_u32('id', 'negatives'))} c) t
  UNION ALL SELECT id, toxic, 'valid' FROM {S.VALID} d
  UNION ALL SELECT id, toxic, 'en1' FROM {S.VALID} e
  UNION ALL SELECT id, toxic, 'en2' FROM {S.VALID} f"""


def _ratio(table: str) -> str:
    return (f"(SELECT count(*) FILTER (WHERE toxic = 1) / CAST(count(*) FILTER (WHERE toxic = 1) + count(*) FILTER (WHERE toxic = 0) AS DOUBLE) "
            f"FROM {table} r)")


@register("train_plan", sql=f"""
WITH u AS ({_TRAIN_PLAN_PARTS}),
w AS (SELECT *, CASE WHEN toxic = 0 THEN {_ratio('u')} / {_ratio(S.VALID)} ELSE toxic END AS weight FROM u)
SELECT id, part, {S.sql_u32("concat_ws('|', id, part)", 'combine')} AS ord, [toxic, round(weight, 9)] AS targets FROM w
""")
def train_plan(spark, sf_dir, n_negatives: int = N_NEG):
    """The composed training table as one plan: M4, U2, A1 with L6 by ratio, target pairs."""
    train = M.compose_trainset(T.set1(spark, sf_dir), T.soft_set2(spark, sf_dir), n_negatives, "binarise")
    valid = T.valid(spark, sf_dir)
    cols = ["id", "comment_text", "toxic"]
    views = {"en1": valid.select(*cols), "en2": valid.withColumn("comment_text", F.lower("comment_text")).select(*cols)}
    both = combine_train_valid(train, valid, views)
    weighted = loss_weight(both, valid, mode="ratio").withColumn("weight", F.round("weight", 9))
    return weighted.select("id", "part", "ord", target_pair("toxic", "weight").alias("targets"))


@register("positives_plus_n", sql=f"""
SELECT id, toxic FROM {S.COMMENTS} a WHERE toxic = 1
UNION ALL SELECT id, toxic FROM {_first_n_sql(f"(SELECT * FROM {S.COMMENTS} q WHERE toxic = 0)", N_NEG, S.sql_u32('id', 'sample'))} b
""")
def positives_plus_n(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    pos = c.filter(F.col("toxic") == 1)
    neg = M.sample_exact_n(c.filter(F.col("toxic") == 0), N_NEG)
    return pos.unionByName(neg).select("id", "toxic")


@register("epoch_resample", sql=f"""
SELECT epoch, id FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY
     {S.sql_u32('id', 'negatives', 42, 'epoch')}, id) AS _rn
  FROM (SELECT * FROM {S2_FLOOR} q WHERE toxic = 0) n, range(1, 4) e(epoch)) x
WHERE _rn <= {N_NEG}
""")
def epoch_resample(spark, sf_dir, n_negatives: int = N_NEG):
    neg = M.training_labels(T.soft_set2(spark, sf_dir)).filter(F.col("toxic") == 0)
    return M.epoch_negatives(neg, n_negatives, epochs=3).select(F.col("epoch").cast("bigint"), "id")


@register("probability_gate", sql=f"""
SELECT doc_id, {S.sql_uniform('doc_id', 'numbers')} < 0.95 AS g95,
       {S.sql_uniform('doc_id', 'synthetic')} < 0.5 AS g50 FROM documents
""")
def probability_gate(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", M.probability_gate(F.col("doc_id"), "numbers", 0.95).alias("g95"),
                    M.probability_gate(F.col("doc_id"), "synthetic", 0.5).alias("g50"))


_SHARD_SQL = f"""
WITH o AS (SELECT id, row_number() OVER (ORDER BY {S.sql_u32('id', 'order')}, id) - 1 AS idx FROM {S.COMMENTS} c),
     n AS (SELECT count(*) AS n FROM o)
SELECT id, idx, CAST(idx % 7 AS INTEGER) AS shard FROM o
UNION ALL
SELECT id, idx + n.n, CAST((idx + n.n) % 7 AS INTEGER) FROM o, n WHERE idx < CAST(ceil(n.n / 7.0) AS BIGINT) * 7 - n.n
"""


@register("shard_rows", sql=_SHARD_SQL)
def shard_rows(spark, sf_dir):
    return M.shard_rows(T.comments(spark, sf_dir), 7).select("id", "idx", "shard")


def _batches_sql(drop_last: bool) -> str:
    base = (f"SELECT id, CAST((row_number() OVER (ORDER BY ord, id) - 1) // 16 AS BIGINT) AS batch_id, "
            f"CAST((row_number() OVER (ORDER BY ord, id) - 1) % 16 AS INTEGER) AS pos_in_batch "
            f"FROM (SELECT id, {S.sql_u32('id', 'shuffle')} AS ord FROM {S.COMMENTS} c) s")
    if not drop_last:
        return base
    return f"SELECT * FROM ({base}) b WHERE batch_id < (SELECT count(*) // 16 FROM {S.COMMENTS} c)"


@register("fixed_batches", sql=_batches_sql(False))
def fixed_batches(spark, sf_dir):
    s = M.shuffle_rows(T.comments(spark, sf_dir))
    return M.fixed_batches(s, 16).select("id", "batch_id", "pos_in_batch")


@register("keep_last_partial", sql=_batches_sql(True))
def keep_last_partial(spark, sf_dir):
    s = M.shuffle_rows(T.comments(spark, sf_dir))
    return M.fixed_batches(s, 16, drop_last=True).select("id", "batch_id", "pos_in_batch")


@register("union_sources", sql=f"""
SELECT id, toxic, 'set1' AS source_name FROM {S.SET1} a
UNION ALL SELECT id, toxic, 'set2' FROM {S.SET2} b
UNION ALL SELECT id, toxic, 'valid' FROM {S.VALID} c
""")
def union_sources_q(spark, sf_dir):
    parts = {"set1": T.set1(spark, sf_dir), "set2": T.set2(spark, sf_dir), "valid": T.valid(spark, sf_dir)}
    return union_sources({k: v.select("id", "toxic") for k, v in parts.items()}, "source_name")


@register("combine_train_valid", sql=f"""
WITH u AS (
  SELECT id, comment_text, toxic, 'train' AS part FROM {S.SET1} a
  UNION ALL SELECT id, comment_text, toxic, 'valid' FROM {S.VALID} b
  UNION ALL SELECT id, comment_text, toxic, 'en1' FROM {S.VALID} c
  UNION ALL SELECT id, lower(comment_text), toxic, 'en2' FROM {S.VALID} d
  UNION ALL SELECT id, comment_text, toxic, 'en3' FROM {S.VALID} e)
SELECT id, part, toxic, md5(comment_text) AS text_md5,
       {S.sql_u32("concat_ws('|', id, part)", 'combine')} AS ord FROM u
""")
def combine_train_valid_q(spark, sf_dir):
    tr = T.set1(spark, sf_dir)
    va = T.valid(spark, sf_dir)
    en1 = va.select("id", "comment_text", "toxic")
    en2 = va.select("id", F.lower("comment_text").alias("comment_text"), "toxic")
    en3 = va.select("id", "comment_text", "toxic")
    out = combine_train_valid(tr, va, {"en1": en1, "en2": en2, "en3": en3})
    return out.select("id", "part", "toxic", F.md5("comment_text").alias("text_md5"), "ord")


@register("dedup_text", sql="""
SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text
""")
def dedup_text_q(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_text(d, "text", "doc_id")
