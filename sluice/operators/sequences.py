"""Vocabulary, encoding and length-bucketed batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import sequences as Q
from sluice.functions.hashing import u32
from sluice.functions.text import as_text
from sluice.operators.ranking import dense_index, join_groups, smallest_n
from sluice.session import materialize


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Corpus token frequencies (map-side combined)."""
    t = df.select(F.explode(Q.tokenize(text_col)).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def build_vocab(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """The ``size`` most frequent tokens -> ids from 4, ``(token, token_id, cnt)``.

    Order: count descending, then a keyed hash of the token, then the token.
    Exact top-``size`` without a global sort of the token table: the count
    distribution (one row per distinct count value) locates the cut-off
    count; tokens above it are all kept and only tokens *at* it are ranked,
    by hash bins (``smallest_n``). The final numbering is a window over at
    most ``size`` rows.
    """
    # the frequency table feeds four branches below: materialize it once
    counts = materialize(token_counts(df, text_col))
    dist = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dist = dist.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    cut = dist.filter((F.col("_before") < size) & (F.col("_before") + F.col("_k") >= size)) \
        .select(F.col("cnt").alias("_vcut"), (F.lit(size) - F.col("_before")).alias("_vneed"))
    # zero or one row: scalar subqueries (null when every token fits)
    tagged = (counts.withColumn("_vcut", cut.select("_vcut").scalar())
              .withColumn("_vneed", cut.select("_vneed").scalar())
              .withColumn("_h", u32(F.col("token"), "vocab")))
    above = tagged.filter(F.col("_vcut").isNull() | (F.col("cnt") > F.col("_vcut")))
    at_cut = smallest_n(tagged.filter(F.col("cnt") == F.col("_vcut")), None, "_h", "token",
                        n_col="_vneed")
    chosen = above.unionByName(at_cut)
    wid = Window.orderBy(F.col("cnt").desc(), F.col("_h"), F.col("token"))
    vocab = chosen.select("token", (F.row_number().over(wid) + Q.FIRST_TOKEN_ID - 1).cast("int").alias("token_id"),
                          "cnt")
    # at most `size` rows, read by every encoding job: write it once
    return materialize(vocab)


def encode_tokens(df: DataFrame, key: str, text_col: str, vocab: DataFrame,
                  cut: tuple[int, str] | None = None) -> DataFrame:
    """J4 + T2 (without markers): ``(key, tokens ARRAY<INT>)``, unknown -> 1.

    A missing text is encoded as the text ``'nan'`` (P5). With ``cut = (L, mode)``
    only tokens that a truncation to L or fewer ids keeps are looked up.
    Tokens are exploded with their position, joined with the vocabulary
    (AQE broadcasts it when it is small) and packed back in position order.
    Partial aggregation packs each row's tokens inside the task that
    exploded them, so the shuffle moves one packed row per key.
    """
    tokens = Q.tokenize(as_text(text_col))
    if cut:
        df, tokens = df.select(key, tokens.alias("_tok")), Q.cut_tokens("_tok", *cut)
    t = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    v = vocab.select("token", "token_id")
    j = t.join(v, "token", "left").withColumn(
        "tid", F.when(F.col("pos").isNull(), F.lit(None)).otherwise(F.coalesce("token_id", F.lit(Q.UNK_ID))))
    packed = j.groupBy(key).agg(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", "tid")))).alias("_s"))
    return packed.select(key, F.transform("_s", lambda s: s["tid"]).alias("tokens"))


def encode(df: DataFrame, key: str, text_col: str, vocab: DataFrame, max_len: int = Q.MAX_LEN,
           mode: str = "head_tail") -> DataFrame:
    """T2 + T3/T4/T5 + T6 + T7 + T8: fixed-length ``ids``, ``mask``, ``token_type_ids``."""
    toks = encode_tokens(df, key, text_col, vocab, (max_len, mode))
    if mode == "head_tail":
        ids = Q.truncate_head_tail(Q.add_markers("tokens"), max_len)
    elif mode == "inner":
        ids = Q.truncate_inner("tokens", max_len)
    elif mode == "right":
        ids = Q.truncate_right(Q.add_markers("tokens"), max_len)
    else:
        raise ValueError(mode)
    out = toks.select(key, ids.alias("_ids"))
    return out.select(key, Q.pad_right("_ids", max_len).alias("ids"),
                      Q.pad_right(F.transform("_ids", lambda x: F.lit(1)), max_len).alias("mask"),
                      Q.token_type_ids(max_len).alias("token_type_ids"))


def bucket_batches(df: DataFrame, pads, ord_col: str, key: str, batch_size: int,
                   drop_last: bool = False, width: int = Q.BUCKET_WIDTH) -> DataFrame:
    """B1: length-matched batches, as a bucketing sampler emits them: ``(key, bucket, batch_id, pos_in_batch)``.

    Rows arrive in ``ord`` order; a row goes to bucket ``pads // width``;
    whenever a bucket holds ``batch_size`` rows it is emitted as a batch.
    Afterwards the leftovers, bucket by bucket, form the last batches (the
    final partial one is dropped with ``drop_last``). Every row lands in
    exactly one batch, and there are ``ceil(n / bs)`` batches
    (``floor`` with ``drop_last``).

    Only key, order and bucket are ranked. Positions inside a bucket come from
    ``dense_index`` (hash bins, no per-bucket sort of all rows). A full batch
    is emitted when its last row arrives, so full batches are numbered by the
    ``ord`` rank of those completing rows (n / bs rows, again via
    ``dense_index``). Leftovers are fewer than ``buckets * bs`` rows, so their
    numbering window is small.
    """
    b = df.select(key, ord_col, F.floor(pads / width).cast("int").alias("bucket"))
    p = dense_index(b, ord_col, key, ["bucket"], out_col="_p")
    # positions feed the full-batch, completing-row and leftover branches: a
    # narrow table, written once
    p = materialize(p)
    sizes = p.groupBy("bucket").agg(F.count(F.lit(1)).alias("_nb"))  # one row per bucket, max_len / width of them
    p = p.join(F.broadcast(sizes), "bucket").withColumn("_full", F.floor(F.col("_nb") / batch_size) * batch_size)
    full = p.filter(F.col("_p") < F.col("_full")).withColumn("_k", F.floor(F.col("_p") / batch_size))
    completing = full.filter(F.col("_p") % batch_size == batch_size - 1).select("bucket", "_k", ord_col, key)
    seq = dense_index(completing, ord_col, key, out_col="batch_id").select("bucket", "_k", "batch_id")
    full_out = join_groups(full, seq, ["bucket", "_k"]).select(
        key, "bucket", "batch_id", (F.col("_p") % batch_size).cast("int").alias("pos_in_batch"))
    n_full = completing.agg(F.count(F.lit(1))).scalar()
    left = p.filter(F.col("_p") >= F.col("_full"))
    wl = Window.orderBy("bucket", "_p")
    left = left.withColumn("_j", F.row_number().over(wl) - 1).withColumn("_nf", n_full)
    if drop_last:
        n_left = p.filter(F.col("_p") >= F.col("_full")).agg(F.count(F.lit(1))).scalar()
        left = left.filter(F.col("_j") < F.floor(n_left / batch_size) * batch_size)
    left_out = left.select(key, "bucket",
                           (F.col("_nf") + F.floor(F.col("_j") / batch_size)).cast("bigint").alias("batch_id"),
                           (F.col("_j") % batch_size).cast("int").alias("pos_in_batch"))
    return full_out.unionByName(left_out)


def length_buckets(df: DataFrame, ids: str, ord_col: str, key: str, batch_size: int,
                   drop_last: bool = False, width: int = Q.BUCKET_WIDTH) -> DataFrame:
    """B1 with the rows' columns: ``bucket_batches`` joined back once; ``key`` is unique."""
    batches = bucket_batches(df, Q.pad_count(ids), ord_col, key, batch_size, drop_last, width)
    return join_groups(df, batches, [key])


def trim_batch(df: DataFrame, batch_col: str, cols: list[str], ref_col: str) -> DataFrame:
    """Cut ``cols`` to the batch's longest non-zero length of ``ref_col`` if > 2.

    A batch has ``batch_size`` rows, so the per-batch window is small.
    """
    w = Window.partitionBy(batch_col)
    out = df.withColumn("_m", F.max(Q.nonzero_length(ref_col)).over(w))
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_m") > 2, F.slice(c, 1, F.col("_m"))).otherwise(F.col(c)))
    return out.drop("_m")
