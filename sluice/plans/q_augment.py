"""Queries for augmentation: X9, X11, X13, X14, X15, M8, J3."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import sequences as Q
from sluice.operators import augment as G
from sluice.operators import sequences as SQ
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

U = S.sql_u32


def _shuffle_sql(text: str, key: str) -> str:
    sents = f"list_transform({S.split_sentences(text)}, lambda lam_s: {S.py_strip('lam_s')})"
    keyed = f"list_transform({sents}, lambda lam_s, lam_i: {{'h': {U(key, 'sentences', 42, '(lam_i - 1)')}, 's': lam_s}})"
    return f"array_to_string(list_transform(list_sort({keyed}), lambda lam_e: lam_e.s), ' ')"


@register("shuffle_sentences", sql=f"SELECT doc_id, {_shuffle_sql('text', 'doc_id')} AS out FROM documents")
def shuffle_sentences(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select("doc_id", G.shuffle_sentences(F.col("text"), F.col("doc_id")).alias("out"))


def _transforms_cte(src: str, key: str, text: str, name: str = "tf") -> str:
    """CTE chain ``{name}5(key, x, ...)`` applying the gated X11 steps."""
    steps = [("mentions", S.strip_mentions), ("urls", S.strip_urls), ("numbers", S.strip_numbers),
             ("hashtags", S.strip_hashtags), ("dedup", S.dedup_sentences)]
    ctes = [f"{name}0 AS (SELECT *, coalesce(CAST({text} AS VARCHAR), 'nan') AS x FROM {src} s)"]
    for i, (salt, fn) in enumerate(steps, start=1):
        g = f"{S.sql_uniform(key, 'tf_' + salt)} < 0.95"
        ctes.append(f"{name}{i} AS (SELECT * REPLACE (CASE WHEN {g} THEN {fn('x')} ELSE x END AS x) FROM {name}{i-1})")
    return ",\n".join(ctes)


@register("train_transforms", sql=f"""
WITH {_transforms_cte('documents', 'doc_id', 'text')}
SELECT doc_id, x AS out FROM tf5
""")
def train_transforms(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.train_transforms(d, "text", "doc_id", "out").select("doc_id", "out")


POOL_CTE = f"""pc AS (SELECT id, {S.clean_text('comment_text')} AS text, toxic FROM {S.POOL_SOURCE} p
              WHERE comment_text IS NOT NULL),
pd AS (SELECT min(id) AS id, text FROM pc GROUP BY text),
pool AS (SELECT CAST(round_even(pc.toxic, 0) AS INTEGER) AS cls,
                CAST(row_number() OVER (PARTITION BY CAST(round_even(pc.toxic, 0) AS INTEGER)
                     ORDER BY {U('pd.id', 'pool')}, pd.id) - 1 AS BIGINT) AS idx,
                pd.text, pd.id
         FROM pd JOIN pc ON pd.id = pc.id),
psize AS (SELECT cls, count(*) AS n FROM pool GROUP BY cls)"""


def _pool(spark, sf_dir):
    return G.build_pool(T.pool_source(spark, sf_dir))


@register("build_pool", sql=f"WITH {POOL_CTE} SELECT cls, idx, text, id FROM pool")
def build_pool(spark, sf_dir):
    return _pool(spark, sf_dir)


def _draws_cte(src: str) -> str:
    n_non = (f"CASE WHEN toxic <> 0 THEN {U('id', 'n_mixed_non')} % 3 "
             f"ELSE 1 + {U('id', 'n_non')} % 5 END")
    n_tox = f"CASE WHEN toxic <> 0 THEN 1 + {U('id', 'n_mixed_tox')} % 3 ELSE 0 END"
    return f"""slots AS (
  SELECT id, 0 AS cls, unnest(range(1, CAST({n_non} AS BIGINT) + 1)) AS slot FROM {src} a
  UNION ALL
  SELECT id, 1 AS cls, unnest(range(1, CAST({n_tox} AS BIGINT) + 1)) + 10 AS slot FROM {src} b),
draws AS (
  SELECT s.id, CAST(s.slot AS INTEGER) AS slot, s.cls, {U('s.id', 'draw', 42, 's.slot')} % z.n AS idx
  FROM slots s JOIN psize z ON s.cls = z.cls)"""


@register("choice_with_replacement", sql=f"""
WITH {POOL_CTE}, {_draws_cte(S.COMMENTS)}
SELECT id, slot, cls, idx FROM draws
""")
def choice_with_replacement(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    return G.draw_slots(c, "id", "toxic", _pool(spark, sf_dir)).select(
        "id", F.col("slot").cast("int").alias("slot"), "cls", "idx")


@register("pool_join", sql=f"""
WITH {POOL_CTE}, {_draws_cte(S.COMMENTS)}
SELECT d.id, d.slot, d.cls, d.idx, p.text AS pool_text FROM draws d JOIN pool p ON d.cls = p.cls AND d.idx = p.idx
""")
def pool_join(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    pool = _pool(spark, sf_dir)
    j = G.pool_join(G.draw_slots(c, "id", "toxic", pool), pool)
    return j.select("id", F.col("slot").cast("int").alias("slot"), "cls", "idx", "pool_text")


def _mix_sql(src: str, text: str, out: str) -> str:
    """Rows of ``src`` (id, {text}, toxic) -> (id, {out}) with synthetic mixing."""
    return f"""g AS (SELECT *, {S.sql_uniform('id', 'synthetic')} < 0.5 AS gated FROM {src} q),
{_draws_cte("(SELECT * FROM g WHERE gated)")},
parts AS (SELECT id, 0 AS slot, {text} AS t FROM g WHERE gated
          UNION ALL SELECT d.id, d.slot, p.text FROM draws d JOIN pool p ON d.cls = p.cls AND d.idx = p.idx),
mixed AS (SELECT id, string_agg(t, ' ' ORDER BY {U('id', 'mixorder', 42, 'slot')}, slot, t) AS {out}
          FROM parts GROUP BY id)
SELECT id, {text} AS {out} FROM g WHERE NOT gated
UNION ALL SELECT id, {out} FROM mixed"""


@register("synthetic_mix", sql=f"WITH {POOL_CTE}, {_mix_sql(S.COMMENTS, 'comment_text', 'text_mix')}")
def synthetic_mix(spark, sf_dir):
    c = T.comments(spark, sf_dir)
    return G.synthetic_mix(c, "id", "comment_text", "toxic", _pool(spark, sf_dir)).select("id", "text_mix")


def _route_sql() -> str:
    tf = _transforms_cte(S.COMMENTS, "id", "comment_text")
    ln = f"least(len({S.tokens('x')}) + 2, 196)"
    mix = _mix_sql("(SELECT id, x, toxic FROM routed WHERE route = 'synthetic')", "x", "text_out")
    return f"""WITH {POOL_CTE}, {tf},
routed AS (SELECT id, toxic, x, CASE WHEN {ln} > 0.8 * 196 THEN 'shuffle' WHEN {ln} < 60 THEN 'synthetic'
                  ELSE 'keep' END AS route FROM tf5),
syn AS (WITH {mix})
SELECT id, route, {_shuffle_sql('x', 'id')} AS text_out FROM routed WHERE route = 'shuffle'
UNION ALL SELECT id, route, x FROM routed WHERE route = 'keep'
UNION ALL SELECT s.id, 'synthetic', s.text_out FROM syn s"""


def _augment_encode_sql() -> str:
    marked = S.with_markers("tokens")
    return f"""WITH routed_text AS ({_route_sql()}),
{S.vocab_cte(2000)},
{S.encoded_cte('routed_text', 'id', 'text_out')}
SELECT id, CASE WHEN len({marked}) > 196 THEN list_concat({marked}[1:195], [3]) ELSE {marked} END AS ids FROM enc"""


@register("augment_encode", sql=_augment_encode_sql())
def augment_encode(spark, sf_dir):
    """X15 then T2 and T5: the routed text is tokenized again, as training examples are."""
    c = T.comments(spark, sf_dir).select("id", "comment_text", "toxic")
    routed = G.augment_route(c, "id", "comment_text", "toxic", _pool(spark, sf_dir))
    vocab = SQ.build_vocab(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2000)
    toks = SQ.encode_tokens(routed, "id", "text_out", vocab, (196, "right"))
    return toks.select("id", Q.truncate_right(Q.add_markers("tokens"), 196).alias("ids"))


@register("augment_route", sql=_route_sql())
def augment_route(spark, sf_dir):
    c = T.comments(spark, sf_dir).select("id", "comment_text", "toxic")
    out = G.augment_route(c, "id", "comment_text", "toxic", _pool(spark, sf_dir))
    return out.select("id", "route", "text_out")
