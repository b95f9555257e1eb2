"""Text augmentation (X9, X11, X13-X15, M8, J3) as joins and array expressions.

Randomness is replaced by keyed hashes of ``(row key, salt, seed, slot)``,
so an augmented training set is reproducible and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.functions.hashing import gate, u32
from sluice.functions.labels import round_half_even
from sluice.functions.sequences import token_count
from sluice.operators.ranking import dense_index
from sluice.operators.sets import dedup_text
from sluice.session import materialize

# Gate probabilities, draw counts, routing thresholds.
TRANSFORM_P = 0.95
SYNTHETIC_P = 0.5
NONTOXIC_DRAWS = (1, 5)       # for a non-toxic row
MIXED_NONTOXIC_DRAWS = (0, 2)  # for a toxic row
MIXED_TOXIC_DRAWS = (1, 3)
ROUTE_MAX_LEN = 196
ROUTE_LONG_FRACTION = 0.8
ROUTE_SHORT_TOKENS = 60


def shuffle_sentences(text, key, seed: int = 42, lang=None) -> Column:
    """Sentences in keyed-hash order, joined by ' '."""
    sents = F.transform(X.split_sentences(text, lang), X.py_strip)
    keyed = F.transform(sents, lambda s, i: F.struct(u32(key, "sentences", seed, i).alias("h"), s.alias("s")))
    return F.concat_ws(" ", F.transform(F.array_sort(keyed), lambda x: x["s"]))


#: X11's steps in their order, (salt of the gate, function of the text).
TRAIN_STEPS = (("mentions", X.strip_mentions), ("urls", X.strip_urls), ("numbers", X.strip_numbers),
               ("hashtags", X.strip_hashtags), ("dedup", X.dedup_sentences))


def train_transforms(df: DataFrame, text_col: str, key: str, out_col: str = "text_aug",
                     seed: int = 42, p: float = TRANSFORM_P, steps: Sequence[tuple[str, Callable]] = TRAIN_STEPS) -> DataFrame:
    """X11: mentions -> urls -> numbers -> hashtags -> sentence dedup, each gated.

    ``steps`` is the chain; any ``(salt, Column -> Column)`` can take part.

    Every step is its own projection so a step's input is computed once (a
    nested ``when(g, f(t)).otherwise(t)`` would copy the whole chain twice
    per step).
    """
    k = F.col(key)
    out = df.withColumn(out_col, X.as_text(text_col))
    for salt, fn in steps:
        out = out.withColumn(out_col, F.when(gate(k, f"tf_{salt}", p, seed), fn(F.col(out_col)))
                             .otherwise(F.col(out_col)))
    return out


def build_pool(src: DataFrame, key: str = "id", text_col: str = "comment_text",
               label_col: str = "toxic", seed: int = 42) -> DataFrame:
    """``(cls, idx, text)`` -- non-null, cleaned, de-duplicated, class by
    half-even rounding, and a dense 0-based index per class in hash order."""
    c = (src.filter(F.col(text_col).isNotNull())
         .select(key, X.clean_text(F.col(text_col)).alias("text"), label_col))
    d = dedup_text(c, "text", key)
    d = d.select(key, "text", round_half_even(label_col).alias("cls"),
                 u32(F.col(key), "pool", seed).alias("_h"))
    pool = dense_index(d, "_h", key, ["cls"], out_col="idx").select("cls", "idx", "text", key)
    # built once and looked up by every draw (class sizes and the pool join)
    return materialize(pool)


def draw_slots(df: DataFrame, key: str, label_col: str, pool: DataFrame, seed: int = 42) -> DataFrame:
    """M8: ``(key, slot, cls, idx)`` -- draws with replacement from the pool.

    A non-toxic row draws 1-5 non-toxic texts; a toxic row 0-2 non-toxic and
    1-3 toxic. ``idx = hash(key, slot) mod class size``; the sizes of the two
    classes are a two-row aggregate joined by broadcast. A draw from a class
    that has no text fails the query.
    """
    k = F.col(key)
    toxic = F.col(label_col) != 0

    def count(salt, lo_hi):
        lo, hi = lo_hi
        return F.lit(lo) + F.pmod(u32(k, salt, seed), F.lit(hi - lo + 1))

    n_non = F.when(toxic, count("n_mixed_non", MIXED_NONTOXIC_DRAWS)).otherwise(count("n_non", NONTOXIC_DRAWS))
    n_tox = F.when(toxic, count("n_mixed_tox", MIXED_TOXIC_DRAWS)).otherwise(F.lit(0))
    slots = F.concat(
        F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, n_non),
                    lambda j: F.struct(F.lit(0).alias("cls"), j.alias("slot"))),
        F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, n_tox),
                    lambda j: F.struct(F.lit(1).alias("cls"), (j + 10).alias("slot"))))
    e = df.select(key, F.explode(slots).alias("_d")).select(key, "_d.cls", "_d.slot")
    sizes = pool.filter(F.col("cls").isin(0, 1)).groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    e = e.join(F.broadcast(sizes), "cls", "left")
    n = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("the pool has no text of class "), F.col("cls").cast("string"))).cast("bigint")
               ).otherwise(F.col("_n"))
    return e.select(key, "slot", "cls", F.pmod(u32(k, "draw", seed, F.col("slot")), n).alias("idx"))


def pool_join(draws: DataFrame, pool: DataFrame) -> DataFrame:
    """Draws -> pool texts, equi-join on ``(cls, idx)`` (AQE picks broadcast
    when the pool is small, a shuffle join otherwise)."""
    return draws.join(pool.select("cls", "idx", F.col("text").alias("pool_text")), ["cls", "idx"])


def synthetic_mix(df: DataFrame, key: str, text_col: str, label_col: str, pool: DataFrame,
                  out_col: str = "text_mix", seed: int = 42, p: float = SYNTHETIC_P) -> DataFrame:
    """With probability p, the text plus drawn pool texts in keyed
    shuffled order, joined by ' '; other rows keep their text.

    Only gated rows enter the draw / join / regroup; the regroup is a
    ``groupBy(key)`` whose groups hold at most 6 texts.
    """
    k = F.col(key)
    g = gate(k, "synthetic", p, seed)
    base = df.withColumn("_g", g)
    keep = base.filter(~F.col("_g")).withColumn(out_col, F.col(text_col)).drop("_g")
    mix = base.filter(F.col("_g")).drop("_g")
    drawn = pool_join(draw_slots(mix, key, label_col, pool, seed), pool) \
        .select(key, F.col("slot").cast("int").alias("slot"), F.col("pool_text").alias("_t"))
    own = mix.select(key, F.lit(0).alias("slot"), F.col(text_col).alias("_t"))
    parts = own.unionByName(drawn).withColumn("_h", u32(k, "mixorder", seed, F.col("slot")))
    packed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_h", "slot", "_t"))).alias("_a"))
    mixed = mix.join(packed.select(key, F.concat_ws(" ", F.transform("_a", lambda s: s["_t"])).alias(out_col)), key)
    return keep.unionByName(mixed)


def augment_route(df: DataFrame, key: str, text_col: str, label_col: str, pool: DataFrame,
                  seed: int = 42, max_len: int = ROUTE_MAX_LEN) -> DataFrame:
    """After X11, long texts get X9, short ones X14, the rest stay.

    Token length = ``min(tokens + 2, max_len)`` (markers, truncation). Only the
    short branch reaches the pool join; the branches are unioned back.
    """
    t = train_transforms(df, text_col, key, "_x", seed)
    t = t.withColumn("_len", F.least(token_count("_x") + 2, F.lit(max_len)))
    long_ = F.col("_len") > ROUTE_LONG_FRACTION * max_len
    short = F.col("_len") < ROUTE_SHORT_TOKENS
    t = t.withColumn("route", F.when(long_, "shuffle").when(short, "synthetic").otherwise("keep"))
    # the transformed text feeds two branches; written once, because running the
    # regex chain again for each costs several times as much as the write
    t = materialize(t)
    short_rows = t.filter(F.col("route") == "synthetic")
    direct = t.filter(F.col("route") != "synthetic").withColumn(
        "text_out", F.when(F.col("route") == "shuffle", shuffle_sentences(F.col("_x"), F.col(key), seed))
        .otherwise(F.col("_x")))
    mixed = synthetic_mix(short_rows, key, "_x", label_col, pool, "text_out", seed)
    return direct.unionByName(mixed).drop("_x", "_len")
