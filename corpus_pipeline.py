"""The corpus pipeline: five stages over ``documents``, each with one operator of ``sluice.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last returns their encoding. ``run`` writes each
stage's rows as Parquet to the shared folder and gives them to the next.

Defined cases: null texts are documents without a letter and go in the first stage;
a null id is an id; repeated rows share their id's decisions; extra columns stay; an
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe
from sluice.llm.common import read_table, stored
from sluice.llm.decontaminate import decontaminate as find_items
from sluice.llm.language_id import fit_documents, language_id
from sluice.llm.line_dedup import line_dedup
from sluice.llm.order_minhash import near_dedup

#: A document whose spans' languages are less certain than this is rejected, and one without a letter. A text
#: of several languages, each of them certain, stays.
LEAST_CERTAIN = 0.3


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (text, rest) with the columns of ``docs``; n_chars follows the text."""
    cols = {c: F.col("text") if c == "text" else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[x.alias(c) for c, x in cols.items()])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "text")


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("other_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("other_id")), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    out = language_id(docs, fit_documents(docs), keep=_others(docs), with_text=True)
    return _columns(out.filter((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAIN)), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents repeat."""
    return _columns(line_dedup(docs, carry=_others(docs)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _with_ids(docs, near_dedup(docs).filter("kept"), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return _with_ids(docs, find_items(docs, read_table(spark, sf_dir, "benchmark")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    source = bpe.word_bpe_source()
    out = bpe.bpe(docs, source, bpe.fit_lexicon(docs, source))
    return out.select("doc_id", "n_tokens", "id_text", F.sha2("id_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Languages, near copies and latent retrieval have no SQL; the test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
