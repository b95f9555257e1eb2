"""Evaluation metrics and meters (A3-A11, W1-W3) as DataFrame aggregations.

ROC AUC is computed exactly, without a global sort or a global window:

* Distinct scores are range-partitioned by boundaries that Spark samples from
  the scores themselves, so bins hold about equally many of them wherever the
  scores lie (trained classifiers put most of them near 0).
* For every distinct score the number of negatives strictly below it is
  "negatives in lower bins" (a prefix sum over one row per bin and group) plus
  "negatives in the same bin with a lower score" (a window *inside* one bin).
* ``AUC = sum(pos * (neg_below + neg_equal / 2)) / (P * N)`` -- ties count half,
  as in the pairwise definition.

A missing or NaN score, or a missing class, has no rank: the query fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.ranking import join_groups
from sluice.session import materialize

# Focal loss alpha / gamma, label smoothing.
FOCAL_ALPHA = 0.5
FOCAL_GAMMA = 1.5
SMOOTHING = 0.1


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def checked_score(score, y=None) -> Column:
    """The score as a double; fails on a missing or NaN score, or on a missing class."""
    s = _c(score).cast("double")
    bad = s.isNull() | F.isnan(s)
    if y is not None:
        bad = bad | _c(y).isNull()
    return F.when(bad, F.raise_error(F.lit("a score or class is missing or not a number")).cast("double")).otherwise(s)


def score_bins(df: DataFrame, score_col: str = "_s", bins: int | None = None) -> DataFrame:
    """``df`` with ``_bin``: a range of scores, about equally many rows in each, in the order of the scores.

    The table is written once: the bins' boundaries come from a sample, and
    every step that follows must see the same ones.
    """
    n = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, score_col).withColumn("_bin", F.spark_partition_id()))


def minmax_scale(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """A3: ``(x - min) / (max - min)`` over the whole column; null when max = min.

    min and max are scalar subqueries (Spark merges them into one aggregate job).
    """
    out_col = out_col or col
    mn = df.agg(F.min(col)).scalar()
    mx = df.agg(F.max(col)).scalar()
    return df.withColumn(out_col, F.try_divide(F.col(col) - mn, mx - mn))


def roc_auc(df: DataFrame, y_col: str = "y", score_col: str = "score",
            group_cols: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """A5: exact ROC AUC per group (null when a class is missing); a null group is a group."""
    g = list(group_cols)
    per_score = (df.groupBy(*g, checked_score(score_col, y_col).alias("_s"))
                 .agg(F.count_if(F.col(y_col) == 1).alias("_pos"),
                      F.count_if(F.col(y_col) == 0).alias("_neg")))
    return roc_auc_counts(per_score, "_s", "_pos", "_neg", g, bins)


def roc_auc_counts(per_score: DataFrame, score_col: str, pos_col: str, neg_col: str,
                   group_cols: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """A5 from per-score class counts ``(score, pos, neg)`` (one row per score)."""
    g = list(group_cols)
    ps = score_bins(per_score.select(*g, checked_score(score_col).alias("_s"), F.col(pos_col).alias("_pos"),
                                     F.col(neg_col).alias("_neg")), "_s", bins)
    per_bin = ps.groupBy(*g, "_bin").agg(F.sum("_neg").alias("_bneg"))
    wb = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("_neg_lower_bins", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)))
    ws = Window.partitionBy(*g, "_bin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    scored = (join_groups(ps, per_bin.select(*g, "_bin", "_neg_lower_bins"), [*g, "_bin"])
              .withColumn("_below", F.col("_neg_lower_bins")
                          + F.coalesce(F.sum("_neg").over(ws), F.lit(0))))
    agg = scored.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_num"),
        F.sum("_pos").cast("bigint").alias("n_pos"), F.sum("_neg").cast("bigint").alias("n_neg"))
    return agg.select(*g, "n_pos", "n_neg",
                      F.try_divide(F.col("_num"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def bce_terms(x, y) -> Column:
    """Stable ``BCEWithLogits`` per element: ``max(x,0) - x*y + log1p(exp(-|x|))``."""
    x, y = _c(x), _c(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_prob_terms(p, y) -> Column:
    """BCE on probabilities (``logits=False``), log clamped at -100 like torch."""
    p, y = _c(p), _c(y)
    lp = F.greatest(F.log(p), F.lit(-100.0))
    l1p = F.greatest(F.log(F.lit(1.0) - p), F.lit(-100.0))
    return -(y * lp + (F.lit(1.0) - y) * l1p)


def weighted_bce(df: DataFrame, x: str, y: str, w: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``sum(w * bce) / N`` per group (divides by the row count, not sum(w))."""
    return df.groupBy(*group_cols).agg(F.avg(F.col(w) * bce_terms(x, y)).alias("loss"))


def focal_loss(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = (),
               alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA,
               logits: bool = True) -> DataFrame:
    """``alpha * (1 - exp(-B))^gamma * B`` with B the *batch mean* BCE."""
    terms = bce_terms(x, y) if logits else bce_prob_terms(x, y)
    b = df.groupBy(*group_cols).agg(F.avg(terms).alias("_b"))
    return b.select(*group_cols, (F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-F.col("_b")), F.lit(gamma))
                                  * F.col("_b")).alias("loss"))


def log_softmax(logits) -> Column:
    """``ARRAY<DOUBLE>`` log-softmax, with the max subtracted for stability."""
    a = _c(logits)
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return F.transform(a, lambda v: v - lse)


def smoothed_ce_terms(logits, target, smoothing: float = SMOOTHING) -> tuple[Column, Column]:
    """Per-row ``(smoothed, plain)`` cross entropy for a class index target."""
    lp = log_softmax(logits)
    nll = -F.element_at(lp, _c(target) + 1)
    mean_neg = -F.aggregate(lp, F.lit(0.0), lambda acc, v: acc + v) / F.size(lp)
    return (F.lit(1.0 - smoothing) * nll + F.lit(smoothing) * mean_neg), nll


def label_smoothing_loss(df: DataFrame, logits: str, target: str, group_cols: Sequence[str] = (),
                         smoothing: float = SMOOTHING) -> DataFrame:
    """Batch mean of the smoothed loss (training) and of plain CE (evaluation)."""
    sm, plain = smoothed_ce_terms(logits, target, smoothing)
    return df.groupBy(*group_cols).agg(F.avg(sm).alias("smoothed"), F.avg(plain).alias("plain"))


def pool_mean_max(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``mean || max`` pooled vector per key (``ARRAY<DOUBLE>``, 2 x dim).

    Mean and maximum over a key's positions are one aggregate over vectors,
    combined map-side; vectors are not taken apart. Null vectors are skipped.
    """
    v = df.filter(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    s = v.groupBy(key).agg(Summarizer.metrics("mean", "max").summary(F.col("_v")).alias("_s"))
    return s.select(key, F.concat(vector_to_array("_s.mean"), vector_to_array("_s.max")).alias("pooled"))


def pool_mean_max_long(df: DataFrame, key: str, vec: str) -> DataFrame:
    """A9 (long form): per ``(key, dim)`` the mean and max over positions."""
    p = pool_mean_max(df, key, vec).withColumn("_n", (F.size("pooled") / 2).cast("int"))
    pairs = F.arrays_zip(F.slice("pooled", 1, F.col("_n")).alias("mean_v"), F.slice("pooled", F.col("_n") + 1, F.col("_n")).alias("max_v"))
    return p.select(key, F.posexplode(pairs).alias("dim", "_p")).select(key, "dim", F.col("_p")["mean_v"].alias("mean_v"), F.col("_p")["max_v"].alias("max_v"))


def loss_by_name(name: str, df: DataFrame, x: str, y: str, w: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """The loss called ``bce``, ``weighted_bce`` or ``focal`` per group, as ``loss``."""
    if name == "weighted_bce":
        return weighted_bce(df, x, y, w, group_cols)
    if name == "bce":
        return weighted_bce(df.withColumn("_one", F.lit(1.0)), x, y, "_one", group_cols)
    if name == "focal":
        return focal_loss(df, x, y, group_cols)
    raise ValueError(f"unknown loss {name!r}")


def average_meter(df: DataFrame, val: str, n: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """A10: ``sum(val * n) / sum(n)``."""
    return df.groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col(val) * F.col(n)), F.sum(n)).alias("avg"),
        F.sum(n).cast("bigint").alias("count"))


def best_epoch(df: DataFrame, epoch: str = "epoch", auc: str = "auc",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Epoch of the best AUC; strictly greater wins (earliest on ties).

    The meter starts at best = 0, epoch = 1: if no epoch beats 0 the answer is 1.
    """
    key = F.struct(F.col(auc).alias("a"), (-F.col(epoch)).alias("ne"))
    agg = df.groupBy(*group_cols).agg(F.max_by(F.col(epoch), key).alias("_e"),
                                      F.max(auc).alias("best_auc"))
    return agg.select(*group_cols, F.when(F.col("best_auc") > 0, F.col("_e")).otherwise(F.lit(1))
                      .cast("int").alias("best_epoch"),
                      F.greatest(F.coalesce(F.col("best_auc"), F.lit(0.0)), F.lit(0.0)).alias("best_auc"))


def running_sums(df: DataFrame, cols: Sequence[str], order_col: str, group_cols: Sequence[str] = (),
                 block_bits: int = 10) -> DataFrame:
    """Inclusive running sums ``cum_<col>`` over a non-negative integer order.

    ``df`` has one row per ``(group, order)``. A running window partitioned
    only by group would sort a whole group's sequence in one task; instead
    the order is cut into blocks of ``2^block_bits`` values. Block totals
    (``1 / 2^block_bits`` of the rows) get their offsets from a small
    prefix-sum window, and the running part is a window inside each block.
    """
    g = list(group_cols)
    d = df.withColumn("_rblk", F.shiftright(F.col(order_col).cast("bigint"), block_bits))
    blocks = d.groupBy(*g, "_rblk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in cols])
    wb = Window.partitionBy(*g).orderBy("_rblk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*g, "_rblk", *[F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_off_{c}")
                                          for c in cols])
    wi = Window.partitionBy(*g, "_rblk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = join_groups(d, blocks, [*g, "_rblk"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(wi))
    return out.drop("_rblk", *[f"_off_{c}" for c in cols])


def running_loss(steps: DataFrame, val: str, n: str, step: str = "step",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """AverageMeter value after each step.

    Rows are first reduced to one per ``(group, step)`` (partial aggregation);
    the running sums over the step sequence are then block-distributed
    (``running_sums``), so no task holds a whole run's steps.
    """
    g = list(group_cols)
    per = steps.groupBy(*g, step).agg(F.sum(F.col(val) * F.col(n)).alias("_sv"), F.sum(n).alias("_n"))
    cum = running_sums(per, ["_sv", "_n"], step, g)
    return cum.select(*g, step, (F.col("cum__sv") / F.col("cum__n")).alias("avg_loss"))


def best_so_far(df: DataFrame, epoch: str = "epoch", auc: str = "auc",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Running best AUC and its epoch (earliest wins ties, start 0 / 1)."""
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(auc).alias("a"), (-F.col(epoch)).alias("ne"))).over(w)
    out = df.select(*g, epoch, auc, best.alias("_b"))
    ok = F.col("_b")["a"] > 0
    return out.select(*g, epoch, auc,
                      F.when(ok, F.col("_b")["a"]).otherwise(F.lit(0.0)).alias("best_auc"),
                      F.when(ok, -F.col("_b")["ne"]).otherwise(F.lit(1)).cast("int").alias("best_epoch"))


def _credit_across(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair contributions between two sets of cells sharing ``keys``.

    ``left`` / ``right`` hold cells ``(keys..., _b, _s, _y, _c)`` (``right``
    also ``_t``). Every right positive is credited with the left negatives
    scored below it (ties half); every right negative with the left
    positives scored above it. The left counts below / above an arbitrary
    score are a prefix sum over score bins (one row per key and bin) plus a
    window inside one bin over a per-score table that holds the scores of
    both sides -- no pair of rows is ever formed.
    """
    k = list(keys)
    scores = (left.select(*k, "_b", "_s",
                          F.when(F.col("_y") == 0, F.col("_c")).otherwise(0).alias("_ln"),
                          F.when(F.col("_y") == 1, F.col("_c")).otherwise(0).alias("_lp"))
              .unionByName(right.select(*k, "_b", "_s", F.lit(0).cast("bigint").alias("_ln"),
                                        F.lit(0).cast("bigint").alias("_lp"))))
    per_score = scores.groupBy(*k, "_b", "_s").agg(F.sum("_ln").alias("_ln"), F.sum("_lp").alias("_lp"))
    ws = Window.partitionBy(*k, "_b").orderBy("_s")
    per_score = (per_score
                 .withColumn("_ln_below", F.coalesce(
                     F.sum("_ln").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .withColumn("_lp_above", F.coalesce(
                     F.sum("_lp").over(ws.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))))
    per_bin = per_score.groupBy(*k, "_b").agg(F.sum("_ln").alias("_bn"), F.sum("_lp").alias("_bp"))
    wb = Window.partitionBy(*k).orderBy("_b")
    per_bin = per_bin.select(
        *k, "_b",
        F.coalesce(F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ln_lower"),
        F.coalesce(F.sum("_bp").over(wb.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_lp_higher"))
    credited = join_groups(join_groups(right, per_score, [*k, "_b", "_s"]), per_bin, [*k, "_b"])
    value = F.when(F.col("_y") == 1,
                   F.col("_c") * (F.col("_ln_lower") + F.col("_ln_below") + F.col("_ln") / 2.0)) \
        .otherwise(F.col("_c") * (F.col("_lp_higher") + F.col("_lp_above") + F.col("_lp") / 2.0))
    return credited.select(*[c for c in k if not c.startswith("_")], "_t", value.alias("_d"))


def running_auc(rows: DataFrame, y: str = "y", score: str = "score", step: str = "step",
                group_cols: Sequence[str] = (), bins: int | None = None,
                seeds: bool = True) -> DataFrame:
    """AUC over all rows up to and including each step (exact).

    With ``seeds`` the meter starts from the two points ``(y=0, .5)`` and
    ``(y=1, .5)``. Each positive/negative pair contributes once, at the later
    of its two steps, and the numerator at step t is the running sum of those
    contributions. Pairs are counted by divide and conquer over the bits of
    the step number: at level k (k >= 1) the steps are cut into blocks of
    ``2^k``, and the second half of each block is credited with the opposite
    class in the first half (``_credit_across``); the same-step pairs form
    level 0. Every pair falls in exactly one level (the highest bit in which
    its steps differ), so the cost is ``O(rows * log(steps))`` shuffled rows.
    No pair of rows and no steps-by-bins grid is ever built, and rows are
    first collapsed to ``(step, score, class)`` cells, so a score shared by
    a third of all rows is one cell per step. Inside a block, cells are ranked
    by ranges of scores whose boundaries are sampled from the cells.
    """
    g = list(group_cols)
    # steps shifted by one so the seed points sit at step 0, before every real step
    r = rows.select(*g, (F.col(step).cast("bigint") + 1).alias("_t"), F.col(y).cast("int").alias("_y"),
                    checked_score(score, y).alias("_s"))
    if seeds:
        pts = F.array(*[F.struct(F.lit(0).cast("bigint").alias("_t"), F.lit(c).alias("_y"),
                                 F.lit(0.5).alias("_s")) for c in (0, 1)])
        if g:
            seed_rows = r.select(*g).distinct().select(*g, F.explode(pts).alias("_p")).select(*g, "_p.*")
        else:
            seed_rows = rows.sparkSession.range(1).select(F.explode(pts).alias("_p")).select("_p.*")
        r = r.unionByName(seed_rows)
    # every level reads the cells: written once, with their ranges of scores
    cells = score_bins(r.groupBy(*g, "_t", "_s", "_y").agg(F.count(F.lit(1)).alias("_c")), "_s", bins).withColumnRenamed("_bin", "_b")
    top = cells.agg(F.max("_t")).first()[0] or 0   # one scalar: the number of levels

    # every cell once per level, tagged with its block and side; one credit
    # pass keyed by (level, block) then covers all levels together.
    # level 0: pairs inside one step (negatives credit the positives);
    # level k: second half of each 2^k-step block against the first half
    levels = int(top).bit_length()
    lv = cells.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    lv = lv.withColumn("_blk", F.expr("shiftright(_t, _lvl)"))
    first_half = F.when(F.col("_lvl") == 0, F.col("_y") == 0).otherwise(
        F.expr("shiftright(_t, _lvl - 1) & 1") == 0)
    lv = lv.withColumn("_left", first_half)
    contrib = _credit_across(lv.filter(F.col("_left")), lv.filter(~F.col("_left")),
                             [*g, "_lvl", "_blk"])
    contrib = contrib.groupBy(*g, "_t").agg(F.sum("_d").alias("_d"))

    totals = cells.groupBy(*g, "_t").agg(F.sum(F.when(F.col("_y") == 1, F.col("_c")).otherwise(0)).alias("_np"),
                                         F.sum(F.when(F.col("_y") == 0, F.col("_c")).otherwise(0)).alias("_nn"))
    per_step = join_groups(totals, contrib, [*g, "_t"], "left").fillna({"_d": 0.0})
    cum = running_sums(per_step, ["_d", "_np", "_nn"], "_t", g)
    out = cum.select(*g, (F.col("_t") - 1).alias(step),
                     F.try_divide(F.col("cum__d"), F.col("cum__np") * F.col("cum__nn")).alias("auc"))
    return out.filter(F.col(step) >= 0) if seeds else out
