"""Exact, distributed ranking by a uniform hash order.

Several operators need "the first N rows in hash order" or "the dense position
of each row in hash order" inside a group (an epoch, a class, a length
bucket). The textbook ``row_number() OVER (PARTITION BY g ORDER BY h)`` puts
an entire group into one task -- with three epochs or two classes that is a
third or half of all rows in a single sort. Instead:

1. ``bin`` = the top ``bits`` bits of the 32-bit hash ``h``. Because ``h`` is
   uniform, every bin holds ``rows / 2^bits`` rows of its group.
2. A histogram ``(g, bin) -> count`` is built with map-side partial
   aggregation; it has at most ``groups * 2^bits`` rows.
3. An exclusive prefix sum over the histogram gives every bin its offset.
4. Only the ordering *inside* a bin needs a window: ``PARTITION BY g, bin``
   spreads the work over ``groups * 2^bits`` evenly sized window groups.

For "first N" only the single bin that straddles N is ranked at all; rows in
lower bins are kept without any shuffle. Ties on ``h`` are broken by a
caller-supplied unique column, so results are exact and deterministic.

Rows meet the histogram on ``(g, bin)``, the same keys that the window needs, so
the join adds no shuffle of its own and needs no broadcast. Group columns are
compared null-safely: rows with a null group are a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BITS = 16


def _bin(h_col: str, bits: int) -> Column:
    return F.shiftright(F.col(h_col), 32 - bits)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; the columns of ``left``, then the others of ``right``."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def hash_histogram(df: DataFrame, h_col: str, group_cols: Sequence[str] = (),
                   bits: int = DEFAULT_BITS) -> DataFrame:
    """``(group..., _bin, _cnt, _before)`` with ``_before`` = rows in lower bins."""
    g = list(group_cols)
    hist = (df.select(*g, _bin(h_col, bits).alias("_bin"))
            .groupBy(*g, "_bin").agg(F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).cast("bigint"))


def dense_index(df: DataFrame, h_col: str, tie_col: str, group_cols: Sequence[str] = (),
                out_col: str = "idx", bits: int = DEFAULT_BITS) -> DataFrame:
    """0-based position of each row in ``(h, tie)`` order within its group.

    The only shuffle of the full data is by ``(group, bin)``; join and window share it.
    """
    g = list(group_cols)
    hist = hash_histogram(df, h_col, g, bits).select(*g, "_bin", "_before")
    tagged = df.withColumn("_bin", _bin(h_col, bits))
    joined = join_groups(tagged, hist, [*g, "_bin"])
    w = Window.partitionBy(*g, "_bin").orderBy(F.col(h_col), F.col(tie_col))
    return (joined.withColumn(out_col, (F.col("_before") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("_bin", "_before"))


def smallest_n(df: DataFrame, n: int | None, h_col: str, tie_col: str,
               group_cols: Sequence[str] = (), strict: bool = False,
               bits: int = DEFAULT_BITS, error: str = "sample larger than population",
               n_col: str | None = None, groups_bound: int | None = None) -> DataFrame:
    """Exactly the first ``n`` rows in ``(h, tie)`` order per group.

    ``strict=True`` fails the query (``raise_error``, evaluated inside the
    plan, no driver round trip) when a group holds fewer than ``n`` rows, as
    ``DataFrame.sample(n=...)`` does; otherwise the whole group is returned,
    as ``head(n)`` does. Groups with no rows at all are simply absent.
    ``n_col`` names a column holding a data-dependent limit (constant per
    group) instead of the literal ``n``. ``groups_bound`` states that there are
    no more groups than that, as the number of epochs does: the cuts, one row
    per group, are then broadcast. Otherwise rows meet their group's cut on
    ``(group, bin)``, so that a group of very many rows is no hot key.
    """
    g = list(group_cols)
    if n_col is None and n < 1:
        return df.limit(0)
    if strict and n_col:
        raise ValueError("strict size checks need a literal n")
    n_expr = F.col(n_col) if n_col else F.lit(n)
    hist = (df.select(*g, _bin(h_col, bits).alias("_bin"), n_expr.alias("_n"))
            .groupBy(*g, "_bin").agg(F.count(F.lit(1)).alias("_cnt"), F.max("_n").alias("_n")))
    wb = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(wb), F.lit(0)).cast("bigint"))
    is_cut = (F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_cnt") >= F.col("_n"))
    # one row per group (one row overall without groups, even on empty input):
    # its size, the bin that holds the n-th row, and how many rows of that bin
    per_group = hist.groupBy(*g).agg(
        F.sum("_cnt").alias("_total"),
        F.max(F.when(is_cut, F.col("_bin"))).alias("_cut_bin"),
        F.max(F.when(is_cut, F.col("_n") - F.col("_before"))).alias("_need"))
    if strict:
        per_group = per_group.withColumn(
            "_cut_bin", F.when(F.coalesce(F.col("_total"), F.lit(0)) < n,
                               F.raise_error(F.lit(error)).cast("bigint"))
            .otherwise(F.col("_cut_bin")))
    tagged = df.withColumn("_bin", _bin(h_col, bits))
    if g and groups_bound:
        joined = join_groups(tagged, F.broadcast(per_group), g)
    elif g:
        by_bin = join_groups(hist.select(*g, "_bin"), per_group, g)
        joined = join_groups(tagged, by_bin, [*g, "_bin"])
    else:
        # one row: attach its values as scalar subqueries (merged into one job)
        joined = (tagged.withColumn("_cut_bin", per_group.select("_cut_bin").scalar())
                  .withColumn("_need", per_group.select("_need").scalar()))
    below = joined.filter(F.col("_cut_bin").isNull() | (F.col("_bin") < F.col("_cut_bin")))
    edge = joined.filter(F.col("_bin") == F.col("_cut_bin"))
    w = Window.partitionBy(*g, "_bin").orderBy(F.col(h_col), F.col(tie_col))
    edge = edge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_need"))
    cols = df.columns
    return below.select(*cols).unionByName(edge.select(*cols))
