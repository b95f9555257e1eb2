"""Sampling, ordering and sharding (M1-M10) with keyed hashes.

No operator here calls ``rand()``: every draw is a keyed hash of the row key,
so a retried task, a lost executor or another partition count yields exactly
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.hashing import gate, u32
from sluice.functions.labels import TOXIC_THRESHOLD, binarise, floor_below
from sluice.operators.ranking import dense_index, smallest_n
from sluice.operators.sets import union_sources

# Negatives drawn per epoch, epochs, smoke-run row caps.
NEGATIVES_PER_EPOCH = 100_000
EPOCHS = 3
SMOKE_ROWS = 2_000


def with_order(df: DataFrame, key: str = "id", salt: str = "order", seed: int = 42,
               out_col: str = "ord", epoch_col: str | None = None) -> DataFrame:
    """Attach the keyed shuffle order ``ord`` (uniform 32-bit draw)."""
    extra = [F.col(epoch_col)] if epoch_col else []
    return df.withColumn(out_col, u32(F.col(key), salt, seed, *extra))


def sample_exact_n(df: DataFrame, n: int, key: str = "id", salt: str = "sample",
                   seed: int = 42, strict: bool = True) -> DataFrame:
    """M1: exactly ``n`` rows without replacement; fails if ``n`` > rows."""
    ordered = with_order(df, key, salt, seed, "_h")
    return smallest_n(ordered, n, "_h", key, strict=strict).drop("_h")


def shuffle_rows(df: DataFrame, key: str = "id", salt: str = "shuffle", seed: int = 42,
                 num_partitions: int | None = None) -> DataFrame:
    """M2: a shuffled table = the rows plus their order column ``ord``.

    The order is a column, not a physical arrangement; ``repartitionByRange``
    on it spreads the rows evenly when a physical shuffle is wanted, and a
    consumer sorts only when it needs sequence.
    """
    out = with_order(df, key, salt, seed, "ord")
    if num_partitions:
        out = out.repartitionByRange(num_partitions, "ord", key)
    return out


def shuffle_head(df: DataFrame, n: int = SMOKE_ROWS, key: str = "id", salt: str = "shuffle",
                 seed: int = 42) -> DataFrame:
    """M3: shuffle then ``head(n)`` -- all rows when there are fewer than ``n``."""
    ordered = with_order(df, key, salt, seed, "ord")
    return smallest_n(ordered, n, "ord", key, strict=False)


def epoch_negatives(negatives: DataFrame, n: int, epochs: int, key: str = "id",
                    salt: str = "negatives", seed: int = 42) -> DataFrame:
    """M6: an independent ``n``-row draw of negatives for every epoch, one job.

    Negatives are replicated ``epochs`` times (``explode``), hashed with the
    epoch number, and the first ``n`` per epoch are kept by ``smallest_n`` --
    no per-epoch window over all negatives.
    """
    rep = negatives.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    rep = rep.withColumn("_h", u32(F.col(key), salt, seed, F.col("epoch")))
    return smallest_n(rep, n, "_h", key, group_cols=["epoch"], strict=True, groups_bound=epochs).drop("_h")


def training_labels(df: DataFrame, mode: str = "binarise", threshold: float = TOXIC_THRESHOLD,
                    label_col: str = "toxic") -> DataFrame:
    """Labels as the training table has them from its load on: L1 (``binarise``) or L2 (``floor``).

    In both modes a label below the threshold is 0, so the row is a negative.
    """
    if mode not in ("binarise", "floor"):
        raise ValueError(f"unknown label mode {mode!r}")
    label = binarise(label_col, threshold).cast("double") if mode == "binarise" else floor_below(label_col, threshold)
    return df.withColumn(label_col, label)


def compose_trainset(set1: DataFrame, set2: DataFrame, n_negatives: int, mode: str = "binarise",
                     threshold: float = TOXIC_THRESHOLD, seed: int = 42) -> DataFrame:
    """M4: set1, the positives of set2 and exactly ``n_negatives`` of its negatives, tagged by ``part``."""
    s2 = training_labels(set2, mode, threshold)
    neg = sample_exact_n(s2.filter(F.col("toxic") == 0), n_negatives, salt="negatives", seed=seed)
    return union_sources({"set1": set1, "set2_pos": s2.filter(F.col("toxic") >= threshold), "set2_neg": neg}, "part")


def epoch_trainsets(set1: DataFrame, set2: DataFrame, n_negatives: int, epochs: int, mode: str = "binarise",
                    threshold: float = TOXIC_THRESHOLD, exclude: DataFrame | None = None, key: str = "id",
                    seed: int = 42) -> DataFrame:
    """M4 for every epoch (M6): the fixed part repeated, the negatives drawn anew.

    ``exclude`` holds keys that must stay out of the draw, such as those of the
    validation rows.
    """
    if exclude is not None:
        set1, set2 = (t.join(exclude.select(key), key, "left_anti") for t in (set1, set2))
    s2 = training_labels(set2, mode, threshold)
    neg = epoch_negatives(s2.filter(F.col("toxic") == 0), n_negatives, epochs, key, seed=seed)
    fixed = union_sources({"set1": set1, "set2_pos": s2.filter(F.col("toxic") >= threshold)}, "part")
    fixed = fixed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return fixed.unionByName(neg.withColumn("part", F.lit("set2_neg")))


def probability_gate(key, salt: str, p: float, seed: int = 42):
    """M7: per-row Bernoulli(p) decision as a boolean column."""
    return gate(key, salt, p, seed)


def shard_rows(df: DataFrame, shards: int, key: str = "id", salt: str = "order",
               seed: int = 42) -> DataFrame:
    """M9: ``i -> i % W`` in shuffle order, padded by wrap-around to equal size.

    Adds ``idx`` (position in the padded sequence) and ``shard``. The row
    count is a scalar subquery (one value, no join). With fewer rows than
    padding needed, rows repeat as often as it takes.
    """
    ordered = dense_index(with_order(df, key, salt, seed, "_h"), "_h", key, out_col="idx").drop("_h")
    ordered = ordered.withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    per_shard = F.ceil(F.col("_n") / F.lit(shards))
    # copy k of row i has the place i + k * n in the padded sequence
    copies = F.ceil((per_shard * shards - F.col("idx")) / F.col("_n"))
    both = ordered.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    both = both.withColumn("idx", F.col("idx") + F.col("_k") * F.col("_n")).drop("_k")
    return both.withColumn("shard", F.pmod(F.col("idx"), F.lit(shards)).cast("int")).drop("_n")


def fixed_batches(df: DataFrame, batch_size: int, order_col: str = "ord", key: str = "id",
                  drop_last: bool = False) -> DataFrame:
    """Consecutive batches of ``batch_size`` in ``order_col`` order."""
    idx = dense_index(df, order_col, key, out_col="_pos")
    out = idx.withColumn("batch_id", F.floor(F.col("_pos") / batch_size).cast("bigint")) \
             .withColumn("pos_in_batch", F.pmod(F.col("_pos"), F.lit(batch_size)).cast("int"))
    if drop_last:
        n = df.agg(F.count(F.lit(1))).scalar()
        out = out.filter(F.col("batch_id") < F.floor(n / batch_size))
    return out.drop("_pos")
