"""Queries for learned sentence ends (X7): the model's scores, and every document split by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import sentences as X
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T

OPENING, CLOSING = (c.replace("'", "''") for c in (X.OPENING, X.CLOSING))


def _ln(x: str) -> str:
    return f"ln(greatest({x}, 1e-12))"


def _two(k: str, m: str, q: str) -> str:
    return f"(({k}) * {_ln(q)} + (({m}) - ({k})) * {_ln(f'1 - ({q})')})"


_WORD = f"regexp_replace(t, '^{OPENING}+|{CLOSING}+$', '', 'g')"
_PREV = f"regexp_replace(p, '{CLOSING}+$', '')"

MODEL_SQL = f"""
w AS (SELECT doc_id, lang, unnest(ws) AS t, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, list_filter(string_split_regex(coalesce(text, ''), '{S.WS}+'), lambda lam_x: lam_x <> '') AS ws FROM documents) a),
x AS (SELECT lang, {_WORD} AS token, {_PREV} AS prev FROM (SELECT lang, t, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY i), '') AS p FROM w) b),
k AS MATERIALIZED (
  SELECT lang, CASE WHEN regexp_matches(kind, '\\p{{L}}') THEN kind END AS type, stop, after, before
  FROM (SELECT lang, lower(regexp_replace(token, '[.!?,;:]+$', '')) AS kind, regexp_matches(token, '[^.][.]$') AS stop, regexp_extract(prev, '([.!?])$', 1) AS after,
               CASE WHEN regexp_matches(prev, '[^.][.]$') THEN lower(regexp_replace(regexp_replace(prev, '^{OPENING}+', ''), '[.]$', '')) END AS before FROM x) c),
c AS (SELECT lang, type, count(*) FILTER (stop) AS a, count(*) FILTER (NOT stop) AS b FROM k GROUP BY ALL),
n AS (SELECT lang, sum(a) AS stops, sum(a + b) AS n FROM c GROUP BY lang),
abbr AS MATERIALIZED (
  SELECT lang, type, a AS with_stop, b AS without_stop,
         2 * (a * (ln({X.STOP_SHARE}) - {_ln('stops / n')}) + b * (ln({1 - X.STOP_SHARE!r}) - {_ln('1 - stops / n')}))
         * exp(-len) * (length(type) - len + 1) * pow(len, -b) AS score
  FROM (SELECT *, length(replace(type, '.', ''))::DOUBLE AS len FROM c) d JOIN n USING (lang) WHERE type IS NOT NULL AND a > 0),
short AS MATERIALIZED (SELECT lang, type FROM abbr WHERE score >= {X.LEAST_ABBREVIATION}),
s AS (SELECT k.lang, k.type, count(*) FILTER (k.after <> '' AND short.type IS NULL) AS ab, count(*) AS b
      FROM k LEFT JOIN short ON short.lang = k.lang AND short.type = k.before GROUP BY ALL),
e AS (SELECT lang, sum(ab) AS a, sum(b) AS n FROM s GROUP BY lang),
starter AS MATERIALIZED (
  SELECT lang, type, ab AS starts, b AS n, CASE WHEN ab / a > b / n THEN
         2 * ({_two('ab', 'a', 'ab / a')} + {_two('b - ab', 'n - a', '(b - ab) / greatest(n - a, 1)')} - {_two('ab', 'a', 'b / n')} - {_two('b - ab', 'n - a', 'b / n')}) ELSE 0.0 END AS score
  FROM s JOIN e USING (lang) WHERE type IS NOT NULL AND ab > 0)"""


def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@register("sentence_model", sql=f"""
WITH {MODEL_SQL}
SELECT lang, 'abbreviation' AS kind, type, with_stop AS seen, without_stop AS other, round(score, 5) AS score FROM abbr
UNION ALL SELECT lang, 'starter', type, starts, n - starts, round(score, 5) FROM starter
""")
def sentence_model(spark, sf_dir):
    tokens = X.corpus_tokens(_docs(spark, sf_dir), "text", "lang")
    scores = X.abbreviation_scores(tokens)
    short = scores.filter(F.col("score") >= X.LEAST_ABBREVIATION)
    a = scores.select("lang", F.lit("abbreviation").alias("kind"), "type", F.col("with_stop").alias("seen"), F.col("without_stop").alias("other"), "score")
    b = X.starter_scores(tokens, short).select("lang", F.lit("starter").alias("kind"), "type", F.col("starts").alias("seen"), (F.col("n") - F.col("starts")).alias("other"), "score")
    return a.unionByName(b).withColumn("score", F.round("score", 5))


@register("learned_sentences", sql=f"""
WITH {MODEL_SQL},
pc AS (SELECT doc_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
       FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_extract_all(coalesce(text, ''), '(?s).*?[.!?]{CLOSING}*{S.WS}+|(?s).+$') AS ps FROM documents) a),
nx AS (SELECT *, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM pc),
wd AS (SELECT *, lower(regexp_replace(regexp_extract(piece, '({S.NON_WS}*[^.{S.WS[1:-1]}])[.]{CLOSING}*{S.WS}+$', 1), '^{OPENING}+', '')) AS word,
              regexp_extract(coalesce(nxt, ''), '^{OPENING}*({S.NON_WS}+)', 1) AS following FROM nx),
fl AS (SELECT doc_id, i, piece, nxt IS NULL OR NOT (word <> '' AND EXISTS (SELECT 1 FROM short h WHERE h.lang = wd.lang AND h.type = wd.word))
              OR (regexp_matches(following, '^\\p{{Lu}}') AND EXISTS (SELECT 1 FROM starter h WHERE h.score >= {X.LEAST_STARTER} AND h.lang = wd.lang
                  AND h.type = lower(regexp_replace(wd.following, '[.!?,;:]*{CLOSING}*[.!?,;:]*$', '')))) AS ends FROM wd),
nr AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM fl),
st AS (SELECT doc_id, k, regexp_replace(string_agg(piece, '' ORDER BY i), '{S.WS}+$', '') AS sentence FROM nr GROUP BY ALL),
md AS (SELECT doc_id, count(*) AS n, md5(string_agg(sentence, chr(10) ORDER BY k)) AS digest FROM st GROUP BY doc_id)
SELECT d.doc_id, coalesce(md.n, 0)::INTEGER AS n_sentences, coalesce(md.digest, md5('')) AS sentences_md5 FROM documents d LEFT JOIN md ON d.doc_id = md.doc_id
""")
def learned_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", X.split_learned("text", "lang", X.fit_sentences(docs, "text", "lang")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.concat_ws("\n", "s")).alias("sentences_md5"))
