"""Label-level table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.labels import LOSS_WEIGHT


def label_counts(df: DataFrame, group_cols: Sequence[str] = (), label_col: str = "toxic") -> DataFrame:
    """A1: ``n0`` = rows with label 0, ``n1`` = rows with label 1, ``pos_ratio``.

    Fractional labels fall in neither count; the ratio is null when both
    counts are 0. Partial aggregation makes this one small shuffle.
    """
    y = F.col(label_col)
    agg = df.groupBy(*group_cols).agg(
        F.count_if(y == 0).alias("n0"),
        F.count_if(y == 1).alias("n1"))
    return agg.withColumn("pos_ratio", F.try_divide(F.col("n1"), F.col("n0") + F.col("n1")))


def _ratio(df: DataFrame, label_col: str) -> Column:
    y = F.col(label_col)
    return F.try_divide(F.count_if(y == 1), F.count_if(y == 0) + F.count_if(y == 1))


def loss_weight(train: DataFrame, valid: DataFrame | None = None, w: float = LOSS_WEIGHT,
                mode: str = "constant", label_col: str = "toxic",
                out_col: str = "weight") -> DataFrame:
    """Per-row loss weight.

    * ``mode='off'``: weight 1 for every row.
    * ``mode='constant'``: weight = label, label 0 replaced by ``w``.
    * ``mode='ratio'``: as constant with ``w = train_pos_ratio / valid_pos_ratio``.

    The ratios are scalar subqueries (one value per side), so the weighting
    stays a single lazy plan with no join.
    """
    y = F.col(label_col)
    if mode == "off":
        return train.withColumn(out_col, F.lit(1.0))
    if mode == "constant":
        return train.withColumn(out_col, F.when(y == 0, F.lit(float(w))).otherwise(y.cast("double")))
    if mode != "ratio":
        raise ValueError(f"unknown weight mode {mode!r}")
    if valid is None:
        raise ValueError("ratio mode needs the validation table")
    lw = F.try_divide(train.agg(_ratio(train, label_col)).scalar(), valid.agg(_ratio(valid, label_col)).scalar())
    return train.withColumn(out_col, F.when(y == 0, lw).otherwise(y.cast("double")))


def row_count(df: DataFrame) -> DataFrame:
    """A2: ``len(df)`` as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def batch_count(df: DataFrame, batch_size: int, epochs: int = 1, shards: int = 1) -> DataFrame:
    """``ceil(n / bs)`` batches and ``int(batches * epochs / shards)`` steps."""
    n = F.count(F.lit(1))
    batches = F.ceil(n / F.lit(batch_size)).cast("bigint")
    return df.agg(n.alias("n_rows"), batches.alias("n_batches"),
                  F.floor(batches * F.lit(epochs) / F.lit(shards)).cast("bigint").alias("n_steps"))
