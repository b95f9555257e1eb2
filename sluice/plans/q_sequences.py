"""Queries for vocabulary, encoding, truncation, padding and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import sequences as Q
from sluice.functions.text import as_text
from sluice.operators import sequences as SQ
from sluice.operators.sampling import with_order
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

VOCAB_SIZE = 2000
L = Q.MAX_LEN


def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "text")


def _vocab(spark, sf_dir):
    return SQ.build_vocab(_docs(spark, sf_dir), "text", VOCAB_SIZE)


def _tokens(spark, sf_dir, cut=None):
    return SQ.encode_tokens(_docs(spark, sf_dir), "doc_id", "text", _vocab(spark, sf_dir), cut)


WITH_ENC = f"WITH {S.vocab_cte(VOCAB_SIZE)},\n{S.encoded_cte('documents', 'doc_id', 'text')}\n"


@register("build_vocab", sql=f"WITH {S.vocab_cte(VOCAB_SIZE)} SELECT token, token_id, cnt FROM vocab")
def build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("vocab_join", sql=WITH_ENC + """
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, t.token, CAST(coalesce(v.token_id, 1) AS INTEGER) AS token_id
FROM enc_t t LEFT JOIN vocab v ON t.token = v.token
""")
def vocab_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t = d.select("doc_id", F.posexplode(Q.tokenize("text")).alias("pos", "token"))
    v = _vocab(spark, sf_dir).select("token", "token_id")
    return t.join(v, "token", "left").select(
        "doc_id", "pos", "token", F.coalesce("token_id", F.lit(Q.UNK_ID)).cast("int").alias("token_id"))


@register("encode", sql=WITH_ENC + f"SELECT doc_id, {S.with_markers('tokens')} AS ids FROM enc")
def encode(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", Q.add_markers("tokens").alias("ids"))


@register("truncate_head_tail", sql=WITH_ENC + f"""
SELECT doc_id, {S.head_tail(S.with_markers('tokens'), L)} AS ids_even,
       {S.head_tail(S.with_markers('tokens'), L - 1)} AS ids_odd FROM enc
""")
def truncate_head_tail(spark, sf_dir):
    # what L keeps holds what L - 1 keeps
    t = _tokens(spark, sf_dir, (L, "head_tail")).select("doc_id", Q.add_markers("tokens").alias("ids"))
    return t.select("doc_id", Q.truncate_head_tail("ids", L).alias("ids_even"),
                    Q.truncate_head_tail("ids", L - 1).alias("ids_odd"))


def _inner_sql(L_: int) -> str:
    m = L_ - 2
    h, t = m // 2, m - m // 2
    return (f"list_concat([2], CASE WHEN len(tokens) > {m} THEN list_concat(tokens[1:{h}], "
            f"tokens[len(tokens) - {t} + 1:len(tokens)]) ELSE tokens END, [3])")


@register("truncate_inner", sql=WITH_ENC + f"""
SELECT doc_id, {_inner_sql(L)} AS ids_even, {_inner_sql(L - 1)} AS ids_odd FROM enc
""")
def truncate_inner(spark, sf_dir):
    t = _tokens(spark, sf_dir, (L, "inner"))
    return t.select("doc_id", Q.truncate_inner("tokens", L).alias("ids_even"),
                    Q.truncate_inner("tokens", L - 1).alias("ids_odd"))


@register("truncate_right", sql=WITH_ENC + """
SELECT doc_id, CASE WHEN len(list_concat([2], tokens, [3])) > 196
  THEN list_concat(list_concat([2], tokens, [3])[1:195], [3]) ELSE list_concat([2], tokens, [3]) END AS ids FROM enc
""")
def truncate_right(spark, sf_dir):
    t = _tokens(spark, sf_dir, (196, "right"))
    return t.select("doc_id", Q.truncate_right(Q.add_markers("tokens"), 196).alias("ids"))


PADDED = S.pad_to(S.head_tail(S.with_markers("tokens"), L), L)


@register("pad_right", sql=WITH_ENC + f"SELECT doc_id, {PADDED} AS ids FROM enc")
def pad_right(spark, sf_dir):
    t = _tokens(spark, sf_dir, (L, "head_tail"))
    return t.select("doc_id", Q.pad_right(Q.truncate_head_tail(Q.add_markers("tokens"), L), L).alias("ids"))


def _padded(spark, sf_dir):
    return SQ.encode(_docs(spark, sf_dir), "doc_id", "text", _vocab(spark, sf_dir), L)


@register("attention_mask", sql=WITH_ENC + f"""
SELECT doc_id, list_transform({PADDED}, lambda x: CAST(x > 0 AS INTEGER)) AS mask,
       list_concat(list_transform({S.head_tail(S.with_markers('tokens'), L)}, lambda x: 1),
                   list_transform(range(greatest({L} - len({S.head_tail(S.with_markers('tokens'), L)}), 0)), lambda x: 0)) AS mask_exact
FROM enc
""")
def attention_mask(spark, sf_dir):
    p = _padded(spark, sf_dir)
    return p.select("doc_id", Q.attention_mask("ids").alias("mask"), F.col("mask").alias("mask_exact"))


@register("token_type_ids", sql=f"SELECT doc_id, list_transform(range({L}), lambda x: 0) AS token_type_ids FROM documents")
def token_type_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", Q.token_type_ids(L).alias("token_type_ids"))


@register("token_length", sql=WITH_ENC + f"""
SELECT doc_id, CAST(len(list_filter({PADDED}, lambda x: x <> 0)) AS INTEGER) AS token_length,
       CAST(len(list_filter({PADDED}, lambda x: x = 0)) AS INTEGER) AS pads FROM enc
""")
def token_length(spark, sf_dir):
    p = _padded(spark, sf_dir)
    return p.select("doc_id", Q.token_length("mask").alias("token_length"), Q.pad_count("ids").alias("pads"))


BS = 16
ENC_C = f"""WITH {S.vocab_cte(VOCAB_SIZE)},
{S.encoded_cte(S.COMMENTS, 'id', 'comment_text')},
e AS (SELECT id, {S.sql_u32('id', 'shuffle')} AS ord, {PADDED} AS ids,
             CAST(floor(len(list_filter({PADDED}, lambda x: x = 0)) / 64) AS INTEGER) AS bucket FROM enc),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ord, id) - 1 AS p,
             count(*) OVER (PARTITION BY bucket) AS nb FROM e),
fl AS (SELECT *, p // {BS} AS k FROM p WHERE p < (nb // {BS}) * {BS}),
comp AS (SELECT bucket, k, row_number() OVER (ORDER BY ord, id) - 1 AS seq FROM fl WHERE p % {BS} = {BS} - 1),
lo AS (SELECT *, row_number() OVER (ORDER BY bucket, p) - 1 AS j FROM p WHERE p >= (nb // {BS}) * {BS}),
batches AS (
  SELECT id, ids, bucket, CAST(seq AS BIGINT) AS batch_id, CAST(p % {BS} AS INTEGER) AS pos_in_batch
  FROM fl JOIN comp USING (bucket, k)
  UNION ALL
  SELECT id, ids, bucket, CAST((SELECT count(*) FROM comp) + j // {BS} AS BIGINT), CAST(j % {BS} AS INTEGER) FROM lo)
"""


def _batches(spark, sf_dir, drop_last=False):
    c = T.comments(spark, sf_dir).select("id", "comment_text")
    vocab = _vocab(spark, sf_dir)
    enc = SQ.encode(c, "id", "comment_text", vocab, L)
    enc = with_order(enc, "id", "shuffle", 42, "ord")
    return SQ.length_buckets(enc, "ids", "ord", "id", BS, drop_last=drop_last)


@register("length_buckets", sql=ENC_C + "SELECT id, bucket, batch_id, pos_in_batch FROM batches")
def length_buckets(spark, sf_dir):
    # pads follow from the number of tokens alone: no vocabulary, no ids, only narrow columns are ranked
    c = T.comments(spark, sf_dir).select("id", Q.token_count(as_text("comment_text")).alias("n"))
    c = with_order(c, "id", "shuffle", 42, "ord")
    pads = F.greatest(F.lit(L) - F.col("n") - 2, F.lit(0))
    return SQ.bucket_batches(c, pads, "ord", "id", BS)


@register("trim_batch", sql=ENC_C + """
, m AS (SELECT batch_id, max(len(list_filter(ids, lambda x: x <> 0))) AS mx FROM batches GROUP BY batch_id)
SELECT id, batch_id, CASE WHEN mx > 2 THEN ids[1:mx] ELSE ids END AS ids FROM batches JOIN m USING (batch_id)
""")
def trim_batch(spark, sf_dir):
    b = _batches(spark, sf_dir)
    return SQ.trim_batch(b, "batch_id", ["ids"], "ids").select("id", "batch_id", "ids")
