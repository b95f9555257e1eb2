"""MinHash near-dedup by order MinHash, verified by banded alignment.

Shingles are five consecutive words, labelled by their occurrence number. An
order MinHash sketch takes the ``PICK`` labelled shingles with the least hashes
and keeps them in the order of the text, so that it also tells texts apart whose
shingles are the same but stand elsewhere. ``ROWS`` sketches make a band; texts
that share a band are candidates.

1. One scan gives each row's digest of its words, its bands and its words as
   16-bit hashes. Equal word sequences are one class from here on: the following
   steps see each class once.
2. Bands that a class shares with another are its buckets. In buckets of at most
   ``small`` classes all pairs are candidates. In larger ones every class is
   compared with a pivot, the class with the most company in all its buckets (a
   text that others were copied from shares more bands than its copies do among
   each other). Buckets whose classes are still apart afterwards get further
   rounds, with pivots from outside the first pivot's component. What is then still
   apart goes through an exact prefix filter: two similar texts share one of the
   first shingles of each, in any order of all shingles. They are ordered by counts
   in a sketch of fixed size, the rarest first, so that the shingles of a passage
   which many texts share come last and bring nobody together.
3. A candidate is verified by aligning the two sequences of labelled shingles:
   the longest common subsequence within the band of shifts that the threshold
   allows must be ``similarity`` of all their shingles.
4. Connected components of the verified links are the groups.

Hot buckets: sizes and pivots are map-side aggregates, and rows get them by joins
against one row per bucket, which AQE splits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import byte_words, discard, giving_back, read_table, row_slices, stored
from sluice.llm.components import components

KEY = "op5_order_minhash"

WIDTH, PICK, ROWS, BANDS = 5, 2, 2, 20
CACHE_WORDS = 300_000
SLICE_BYTES = 4_000_000
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64) | np.uint64(1)
_POWERS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & 0xFFFF
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of labelled shingles in the order of the text; texts of one to four words have one."""
    w = words.astype(np.uint64) + np.uint64(1)
    n = max(len(w) - WIDTH + 1, min(len(w), 1))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(w) if len(w) < WIDTH else 0, np.uint64)
    for j in range(min(WIDTH, len(w))):
        h += w[j:j + n] * _POWERS[j]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    if len(first) < n:  # the k-th occurrence of a shingle is another one
        nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        s = s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = h.copy()
        h[order] = s
    return _mix(h)


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a text with shingles ``s``."""
    picks = np.empty((BANDS * ROWS, PICK), np.uint64)
    k = min(PICK, len(s))
    for a in range(0, BANDS * ROWS, 8):
        h = s * _SEEDS[0, a:a + 8, None] + _SEEDS[1, a:a + 8, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = np.argpartition(h, k - 1, axis=1)[:, :k] if k < len(s) else np.tile(np.arange(k), (len(h), 1))
        at.sort(axis=1)  # the order of the text
        picks[a:a + 8] = s[np.pad(at, ((0, 0), (0, PICK - k)), mode="edge")]
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        for j in range(PICK):
            out = _mix(out * _POWERS[0] + picks[r::ROWS][:, j])
    return out.view(np.int64)


def similarity_of(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned labelled shingles, of all that two texts have; 0 if below ``least``."""
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least)  # aligned shingles that make the similarity ``least``
    if min(n, m) < need - 1e-9 or not n:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    where = order[at]
    i = np.flatnonzero((b[where] == a) & (np.abs(where - np.arange(n)) <= n + m - 2 * need + 1e-9))
    if len(i) < need - 1e-9:
        return 0.0
    j = where[i]
    if (np.diff(j) > 0).all():
        got = len(j)
    else:  # each labelled shingle occurs once, so the longest increasing run of places is the alignment
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        got = len(tails)
    s = got / (n + m - got)
    return s if s >= least - 1e-9 else 0.0


# the scan


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE_BYTES)):
        rows = []
        for t in batch.column(1).to_pylist():
            words = byte_words(t)
            w = np.fromiter(map(hashes.__getitem__, words), np.uint16, len(words))
            s = shingles(w)
            rows.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), len(s), bands(s).tolist() if len(s) else [], w.tobytes()))
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                         ["doc_id", "node", "n", "bands", "words"])


def verify_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose sequences of words are similar."""
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        ok = [similarity_of(shingles(np.frombuffer(x, np.uint16)), shingles(np.frombuffer(y, np.uint16)), least) > 0 for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The similar ones of ``pairs`` (u, v); ``texts`` has (node, words)."""
    a, b = (texts.select(F.col("node").alias(x), F.col("words").alias(f"{x}_words")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_words", "v_words").mapInArrow(
        giving_back(lambda it: verify_batches(it, least)), "u binary, v binary")


def ordered(pairs: DataFrame, least: float) -> DataFrame:
    """Distinct pairs of different nodes that are not too different in length."""
    fits = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * (least - 1e-9)
    return pairs.filter(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


COUNTERS = 1 << 18


def counter_of(s: np.ndarray) -> np.ndarray:
    return (_mix(s ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(counter, n): how many shingles of the texts (words) fall to each counter."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for w in batch.column(0).to_pylist():
            n += np.bincount(counter_of(shingles(np.frombuffer(w, np.uint16))), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["counter", "n"])


def prefix_batches(batches: Iterator[pa.RecordBatch], counts, least: float) -> Iterator[pa.RecordBatch]:
    """(shingle, node, component, n, place, short) of each text's first shingles; ``short``: it is among those that a text no longer than its partner needs."""
    for batch in batches:
        for node, component, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = shingles(np.frombuffer(w, np.uint16))
            n = len(s)
            if not n:
                continue
            s = s[np.lexsort((s, counts.value[counter_of(s)]))]
            # at least this many shingles are common, of the longer and of the shorter text
            long, short = (n - int(np.ceil(n * x - 1e-9)) + 1 for x in (least, 2 * least / (1 + least)))
            place = np.arange(min(long, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[:len(place)].view(np.int64)), pa.array([node] * len(place), pa.binary()), pa.array([component] * len(place), pa.binary()),
                 pa.array(np.full(len(place), n)), pa.array(place), pa.array(place < short)], ["shingle", "node", "component", "n", "place", "short"])


def prefix_pairs(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs (u, v) of ``nodes`` (node, component) in different components that can be similar."""
    spark = nodes.sparkSession
    unresolved = nodes.join(texts, "node").select("node", "component", "words")
    counts = np.zeros(COUNTERS, np.int64)
    got = unresolved.select("words").mapInArrow(giving_back(count_shingles), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("counter").to_numpy()] = got.column("n").to_numpy()
    counts_b = spark.sparkContext.broadcast(counts)
    prefixes = stored(unresolved.mapInArrow(giving_back(lambda it: prefix_batches(it, counts_b, least)),
                                        "shingle long, node binary, component binary, n long, place long, short boolean"), "op5-prefixes")
    mixed = prefixes.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shingle")
    rows = prefixes.join(mixed, "shingle")
    a, b = (rows.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "n", "place", "short")]) for x in "ab")
    need = (F.col("a_n") + F.col("b_n")) * (least / (1 + least)) - 1e-6
    # the first shingle that both have: all that is common comes from there on
    left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    on = ((a["shingle"] == b["shingle"]) & F.col("a_short") & (F.col("a_component") != F.col("b_component")) & (F.col("a_n") <= F.col("b_n"))
          & (F.col("a_n") >= F.col("b_n") * (least - 1e-9)) & (left >= need))
    out = stored(a.join(b, on).select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct(), "op5-pairs")
    discard(prefixes)
    return out


def linked(classes: DataFrame, least: float, small: int, rounds: int) -> DataFrame:
    """``(node, component)``, stored, of the classes that have verified links; ``classes`` has (node, n, bands, words), one row per node."""
    exploded = classes.select("node", "n", F.explode("bands").alias("band"))
    sizes = exploded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(exploded.join(sizes, "band").select("band", "node", "n", "size"), "op5-shared")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    few, many = shared.filter(F.col("size") <= small), shared.filter(F.col("size") > small)
    other = few.select("band", F.col("node").alias("b"), F.col("n").alias("b_n"))
    pairs = few.select("band", F.col("node").alias("a"), F.col("n").alias("a_n")).join(other, "band").filter("a < b")
    # ranked by company; the digest of equal company is arbitrary but the same on every run
    many = stored(many.join(company, "node").select("band", "node", "n", F.struct("company", "node", "n").alias("rank")), "op5-many")

    def with_pivot(rows: DataFrame, pivots: DataFrame) -> DataFrame:
        return rows.join(pivots, "band").select(F.col("node").alias("a"), F.col("n").alias("a_n"),
                                                F.col("pivot.node").alias("b"), F.col("pivot.n").alias("b_n"))

    first = many.groupBy("band").agg(F.max("rank").alias("pivot"))
    done = [stored(ordered(pairs.drop("band").unionByName(with_pivot(many, first)), least), "op5-pairs")]
    texts = classes.select("node", "words")
    component = _grown(verified(done[0], texts, least))
    large = many.limit(1).count() > 0
    for r in range(rounds if large else 0):
        placed = many.join(component, "node", "left").select(
            "band", "node", "n", "rank", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("band").agg(F.max(F.struct("rank", "component")).alias("main"), F.min("component").alias("x"), F.max("component").alias("y"))
        mixed = mixed.filter("x <> y").select("band", F.col("main.component").alias("main"))
        # outside the main component: the one with the most company, then others by a hash
        key = F.col("rank.company") if r == 0 else F.xxhash64("node", F.lit(r))
        outside = placed.join(mixed, "band").filter("component <> main")
        pivots = outside.groupBy("band").agg(F.max(F.struct(key.alias("key"), "node", "n", "component")).alias("pivot"))
        rows = placed.join(pivots, "band").filter("component <> pivot.component").drop("pivot")
        done.append(stored(ordered(with_pivot(rows, pivots), least).join(_union(done), ["u", "v"], "left_anti"), "op5-pairs"))
        component = _grown(verified(done[-1], texts, least), component)
    if large:
        placed = many.select("band", "node").join(component, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
        apart = stored(placed.join(mixed, "band").select("node", "component").distinct(), "op5-apart")
        if apart.limit(1).count():
            pairs = prefix_pairs(apart, texts, least)
            component = _grown(verified(pairs.join(_union(done), ["u", "v"], "left_anti"), texts, least), component)
            discard(pairs)
        discard(apart)
    discard(shared, many, *done)
    return component


def _grown(links: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """Components with further links; the table before is deleted."""
    links = stored(links, "op5-links")
    out = components(links, component)
    discard(links, *([] if component is None else [component]))
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, small: int = 8,
               rounds: int = 2) -> DataFrame:
    """Groups of near copies: ``(doc_id, class_id, class_size, exact_id, kept)``, a row per input row.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased.
    Texts are linked when their labelled five-word shingles align to ``similarity``
    of all they have; a class is a connected component. ``class_id`` is its least
    id, ``exact_id`` the least id among rows with the very same words; the row
    with its class's id is kept.

    Defined cases: null, empty and wordless texts have the same words, none, and
    are one class. Texts of one to four words have one shingle, all their words.
    A null id is in no minimum unless a class has no other. Rows that repeat an id
    share the decision of that id when they have the same words. Texts are read
    whole at any length. Other columns are ignored, an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = stored(base.mapInArrow(giving_back(sketch_batches), "doc_id long, node binary, n long, bands array<long>, words binary"), "op5-rows")
    # equal words have equal bands: any row's stand for the class, and copies collapse map-side
    classes = stored(rows.groupBy("node").agg(
        F.min("doc_id").alias("exact_id"), F.count("*").alias("size"), *[F.any_value(c).alias(c) for c in ("n", "bands", "words")]), "op5-classes")
    component = linked(classes, similarity, small, rounds)
    placed = classes.select("node", "exact_id", "size").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("exact_id").alias("class_id"), F.sum("size").alias("class_size"))
    label = placed.join(named, "component").select("node", "exact_id", "class_id", "class_size")
    out = stored(rows.select("doc_id", "node").join(label, "node").select(
        "doc_id", "class_id", "class_size", "exact_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")), "op5-result")
    discard(rows, classes, component)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = None
