"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. One scan gives every text's normalised length and a hash of its first
   ``prefix_chars`` normalised characters. Rows whose length no other row has
   leave; of the others, rows whose (length, prefix hash) no other row has
   leave too. Only narrow columns shuffle.
2. The surviving (length, prefix hash) keys become a bitmap of
   ``2**bitmap_bits`` bits. It is a table of at most ``2**(bitmap_bits - 6)``
   rows of 64 bits, a size set by the parameter and not by the data, so it is
   broadcast; the texts themselves never shuffle. A key that meets another's
   bit only costs one needless full hash.
3. A second scan hashes the whole text of survivors (SHA-256), and a last
   grouping over survivors finds the groups. Groups are aggregated map-side;
   rows get their group back by a join whose other side holds each hash once,
   which AQE splits when a hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, read_table, stored, text_or_empty

KEY = "op1_exact_dedup"


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, SPACE, "")


def _slot(n: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(n, prefix), F.lit(1 << bits))


def surviving_keys(features: DataFrame) -> DataFrame:
    """(n, prefix) of ``features`` that two rows or more share.

    Only prefixes of shared lengths are grouped. Both groupings count map-side
    before they shuffle, so a length that very many rows have is no hot task.
    """
    lengths = features.groupBy("n").agg(F.count("*").alias("rows")).filter("rows > 1").select("n")
    keys = features.groupBy("n", "prefix").agg(F.count("*").alias("rows"))
    return keys.join(lengths, "n", "left_semi").filter("rows > 1").select("n", "prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 256, bitmap_bits: int = 24,
                digests: bool = False) -> DataFrame:
    """Groups of equal texts: ``(doc_id, keep_id, group_size, kept)``, a row per input row.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``. The row
    with the most code points, then the smallest id, stays. ``digests`` adds
    ``text_sha256`` of every row, which reads every whole text in the second scan.

    Defined cases: a null text counts as empty, so null, empty and blank texts
    are one group. A null id ranks behind every other id; a group of null ids
    only has a null ``keep_id`` and is kept. Rows that repeat an id with an
    equal text all count in ``group_size`` and share the decision of that id.
    Other columns are ignored, an empty table gives no rows.
    """
    norm = normalised(F.col("text"))
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = base.select(
        "doc_id", F.length("text").alias("chars"), norm.alias("norm")).select(
        "doc_id", "chars", "norm", F.length("norm").alias("n"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    slot = _slot(F.col("n"), F.col("prefix"), bitmap_bits)
    features = stored(keyed.select("n", "prefix"), "op1-features")
    bitmap = (surviving_keys(features).select(slot.alias("slot"))
              .groupBy(F.shiftright("slot", 6).alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    probed = (keyed.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6))
              .join(F.broadcast(bitmap), "word", "left")
              .withColumn("suspect", F.expr("coalesce(shiftright(bits, cast(slot & 63 as int)) & 1, 0) = 1")))
    sha = F.sha2(F.col("norm"), 256)
    hashed = stored(probed.select(
        "doc_id", "chars", "suspect",
        (sha if digests else F.when(F.col("suspect"), sha)).alias("text_sha256")), "op1-hashed")
    # the longest original first, then the smallest id; a null id comes last
    best = F.max(F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("neg_id")))
    groups = (hashed.filter("suspect").groupBy("text_sha256")
              .agg(F.count("*").alias("group_size"), best.alias("best"))
              .filter("group_size > 1")
              .select("text_sha256", "group_size", (-F.col("best.neg_id")).alias("keep_id"), F.lit(True).alias("grouped")))
    out = hashed.join(groups, "text_sha256", "left") if digests else (
        hashed.join(groups, (hashed.text_sha256 == groups.text_sha256), "left").drop(groups.text_sha256))
    grouped = F.coalesce(F.col("grouped"), F.lit(False))
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    cols = ["doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            keep.eqNullSafe(F.col("doc_id")).alias("kept")]
    return out.select(*cols, *(["text_sha256"] if digests else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), digests=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
      FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
