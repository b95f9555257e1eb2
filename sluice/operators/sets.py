"""Set operations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.hashing import u32


def union_sources(tables: Mapping[str, DataFrame], source_col: str = "source") -> DataFrame:
    """Concatenate by column name, duplicates kept, tagged with the source."""
    tagged = [df.withColumn(source_col, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combine_train_valid(train: DataFrame, valid: DataFrame, views: Mapping[str, DataFrame],
                        seed: int = 42) -> DataFrame:
    """Train + valid + translated views of valid, then a keyed shuffle.

    Rows keep ``(id, source)``; the shuffle order hashes both, so the copy of
    a row coming from another view is placed independently.
    """
    parts = {"train": train, "valid": valid, **views}
    cols = ["id", "comment_text", "toxic"]
    u = union_sources({k: v.select(*cols) for k, v in parts.items()}, "part")
    u = u.withColumn("_key", F.concat_ws("|", F.col("id").cast("string"), F.col("part")))
    return u.withColumn("ord", u32(F.col("_key"), "combine", seed)).drop("_key")


def dedup_text(df: DataFrame, text_col: str = "comment_text", order_col: str = "id") -> DataFrame:
    """One row per distinct text, the first one in ``order_col`` order.

    ``min(struct(order, ...))`` is an ordinary aggregate, so duplicates are
    collapsed map-side before the shuffle: a text shared by a third of all
    rows costs one row per task, not a third of the data in one task (which
    is what ``row_number() OVER (PARTITION BY text ...)`` would do).
    """
    others = [c for c in df.columns if c not in (text_col, order_col)]
    if not others:
        # a fixed-width buffer: hash aggregation, no sort of long text keys
        return df.groupBy(text_col).agg(F.min(order_col).alias(order_col)).select(*df.columns)
    first = F.min(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_first")
    agg = df.groupBy(text_col).agg(first)
    return agg.select(F.col(f"_first.{order_col}").alias(order_col), text_col,
                      *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)
