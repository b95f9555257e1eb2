"""Driver tables and the derived inputs the operators consume.

The engine works on labelled comment tables ``(id, comment_text, toxic, lang,
source)``. On the driver data they are derived from ``documents`` and
``labels``; every derivation is a plain, pushdown-friendly projection / join so
Catalyst prunes the parquet scan to the columns a query touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import u32

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

SET1_SOURCES = [f"src{i}" for i in range(0, 10)]
SET2_SOURCES = [f"src{i}" for i in range(10, 20)]


#: Session setting: the number of partitions that ``table`` deals a scan's rows to.
SCAN_PARTITIONS = "sluice.scan.partitions"
#: Session setting: the tables that this holds for, joined by commas; all if unset.
SCAN_TABLES = "sluice.scan.tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as its files are split.

    ``sluice.scan.partitions`` deals the rows round-robin to that many
    partitions instead, whatever the size of the table; it is meant for files
    of a single row group, which one task reads, and is not set by default.
    ``sluice.scan.tables`` names the tables that it holds for: dealing the rows
    of a narrow table costs more than reading them in one task.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    named = spark.conf.get(SCAN_TABLES, None)
    return df.repartition(int(parts)) if parts and (named is None or name in named.split(",")) else df


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` inner join ``labels`` -> the labelled comment table.

    The join is an equi-join on ``doc_id``; AQE turns it into a broadcast
    join at run time when ``labels`` is small and keeps a sort-merge join when
    it is not, so no size is assumed here.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment_text"), "lang", "source")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic"))
    return docs.join(labels, "id", "inner").select("id", "comment_text", "toxic", "lang", "source")


def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).filter(F.col("source").isin(SET1_SOURCES))


def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).filter(F.col("source").isin(SET2_SOURCES))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).filter(F.col("id") % 5 == 0)


def soft_set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set2 with soft labels, shaped like annotator fractions.

    Positives get ``0.5 + u/2`` (so only some reach the 0.95 threshold);
    negatives stay 0 except where ``u < 0.2``, which get the fraction ``u``.
    ``u`` is the keyed soft draw; results are rounded to 2 digits.
    """
    s2 = set2(spark, sf_dir)
    u = u32(F.col("id"), "soft", 42) / F.lit(4294967296.0)
    return s2.withColumn("toxic", F.when(F.col("toxic") == 1.0, F.round(F.lit(0.5) + u / 2, 2))
                         .when(u < 0.2, F.round(u, 2)).otherwise(F.lit(0.0)))


def translated_views(spark: SparkSession, sf_dir: str):
    """The two other-language views, with their own column names."""
    c = comments(spark, sf_dir)
    en1 = c.select("id", F.col("comment_text").alias("comment_text_en"), "toxic")
    en2 = c.select("id", F.lower("comment_text").alias("translated"), "toxic")
    return en1, en2


def null_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.withColumn("comment_text", F.when(F.col("id") % 10 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("comment_text")))


def test_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled test table ``(id, content, lang)``: every document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")


def pool_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample pool ``(id, comment_text, toxic, lang)`` from ``conversations``."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("comment_text"),
        (F.col("turn") % 2).cast("double").alias("toxic"),
        F.lit("en").alias("lang"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-example metric rows ``(step, y, score, loss, n)`` from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.floor(F.col("event_id") / 100).cast("bigint").alias("step"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("value") / 500.0).alias("score"),
        F.col("value").alias("loss"),
        F.lit(1).alias("n"))
