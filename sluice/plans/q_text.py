"""Queries for the text scalar functions X1-X8, X10, X12 and P5."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.plans import sqltext as S
from sluice.plans.registry import register
from sluice.sources import tables as T


def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _text_query(key: str, spark_fn, sql_fn):
    register(key, sql=f"SELECT doc_id, {sql_fn('text')} AS out FROM documents")(
        lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", spark_fn(F.col("text")).alias("out")))


_text_query("squeeze_spaces", X.squeeze_spaces, S.squeeze_spaces)
_text_query("strip_numbers", X.strip_numbers, S.strip_numbers)
_text_query("strip_digits_quotes", X.strip_digits_quotes, S.strip_digits_quotes)
_text_query("strip_hashtags", X.strip_hashtags, S.strip_hashtags)
_text_query("strip_mentions", X.strip_mentions, S.strip_mentions)
_text_query("dedup_sentences", X.dedup_sentences, S.dedup_sentences)
_text_query("clean_text", X.clean_text, S.clean_text)


@register("strip_urls", sql=f"""
SELECT page_id, {S.strip_urls("concat('see ', url, ' ', html)")} AS out FROM pages
""")
def strip_urls(spark, sf_dir):
    # the documents hold no URLs; pages carry one per row plus links in the HTML
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", X.strip_urls(F.concat(F.lit("see "), "url", F.lit(" "), "html")).alias("out"))


@register("split_sentences", sql=f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, sentence FROM (
  SELECT doc_id, unnest(l) AS sentence, unnest(generate_series(1, len(l))) AS pos
  FROM (SELECT doc_id, {S.split_sentences('text', 'lang')} AS l FROM documents) a) b
""")
def split_sentences(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(X.split_sentences("text", "lang")).alias("pos", "sentence"))


@register("lang_name", sql="""
SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'english' WHEN 'it' THEN 'italian'
  WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' WHEN 'tr' THEN 'turkish'
  WHEN 'ru' THEN 'russian' WHEN 'pt' THEN 'portuguese' END, 'english') AS lang_name FROM documents
""")
def lang_name(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.lang_name("lang").alias("lang_name"))


@register("as_text", sql=f"""
SELECT id, coalesce(CASE WHEN id % 10 = 0 THEN NULL ELSE comment_text END, 'nan') AS text
FROM {S.COMMENTS} c
""")
def as_text(spark, sf_dir):
    n = T.null_fixture(spark, sf_dir)
    return n.select("id", X.as_text("comment_text").alias("text"))
