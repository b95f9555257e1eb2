"""Substring dedup by level-wise doubling: windows of words that repeat at one length alone are looked at again at twice that length.

Windows are hashed by doubling too: the hash of a window of 2n words mixes those
of its two halves, for all windows of a slice of texts at once.

1. The lengths are the target halved until ``least`` is reached, e.g. 25, 50. A
   target window is stood for, at a shorter length, by the window inside it whose
   hash is the least: equal target windows have the same. So a document gives a
   few windows per target length of text, not one per word, and a target window
   can only repeat if the one standing for it does.
2. At each length the documents of every hash are counted, map-side first. Hashes
   that two documents hold go back to the documents, which look only at the target
   windows that they stand for and give the windows of the next length. When no
   hash is left the work ends.
3. At the target length every surviving window is counted by a 128-bit digest; the
   least document of each is known, and all other documents lose it.

A passage that very many documents share is one row per task in the counts, and one of a
bounded number of broadcast rows when it goes back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import discard, join_counted, read_table, row_slices, stored

KEY = "op13_substring_dedup"

SLICE_BYTES = 2_000_000
#: Stands for a null id, which is a document below all others.
NULL_ID = -(1 << 63)


def lengths(target: int, least: int) -> list[int]:
    """The window lengths in ascending order: each at most twice the one before, the last is the target."""
    out = [target]
    while out[0] > least and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(23)) | (b >> np.uint64(41)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of the texts of a slice, as 128-bit hashes in two lanes, one text after the other."""

    def __init__(self, texts: Sequence[bytes | None]):
        rows = [(t or b"").split() for t in texts]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        number: dict[bytes, int] = defaultdict(count().__next__)  # in the order they come
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int32, int(self.sizes.sum()))
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in number]), "<u8").reshape(-1, 2)
        self.lanes = digests[at, 0], digests[at, 1]

    def hashes(self, n: int, lane: int) -> np.ndarray:
        """The hash of the ``n`` words from each place on; those that run over a text's end mean nothing."""
        h, size = self.lanes[lane], 1
        while size < n:
            step = min(size, n - size)
            h = _mixed(h[:-step], h[step:]) if len(h) > step else h[:0]
            size += step
        return h

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of all windows of ``n`` words inside one text."""
        count = np.maximum(self.sizes - n + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.starts, count)


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of ``n`` consecutive values, from each place on."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        size += step
    return h


def _members(text: np.ndarray, h: np.ndarray, texts_of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which (text, h) are among (texts_of, wanted)."""
    if not len(wanted):
        return np.zeros(len(h), bool)
    order = np.lexsort((wanted, texts_of))
    texts_of, wanted = texts_of[order], wanted[order]
    begin, end = np.searchsorted(texts_of, np.arange(int(text.max(initial=0)) + 2)).astype(np.int64), len(wanted)
    lo, hi = begin[text], begin[text + 1]
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = np.minimum((lo + hi) >> 1, end - 1)
        below = (lo < hi) & (wanted[mid] < h)
        lo, hi = np.where(below, mid + 1, lo), np.where((lo < hi) & ~below, mid, hi)
    return (lo < begin[text + 1]) & (wanted[np.minimum(lo, end - 1)] == h)


def _candidates(words: Words, n: int, target: int, lists: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the target windows whose standing window of ``n`` words is in its text's list."""
    text, place = words.windows(target)
    if lists is None:
        return text, place
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    keep = _members(text, least_of(words.hashes(n, 0), target - n + 1)[place], of, flat)
    return text[keep], place[keep]


def _distinct(text: np.ndarray, *h: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(text):
        return (text, *h)
    order = np.lexsort((*h[::-1], text))
    text, h = text[order], [x[order] for x in h]
    new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in (text, *h)])]
    return (text[new], *[x[new] for x in h])


def windows_of(batches: Iterator[pa.RecordBatch], before: int | None, n: int, target: int) -> Iterator[pa.RecordBatch]:
    """(id, hash) of the windows of ``n`` words that stand for a target window, once per text; at the target (id, two lanes).

    Columns id, text and, after the first level, the hashes of length ``before`` that are left.
    """
    for batch in batches:
        for part in row_slices(batch, 1, SLICE_BYTES):
            words = Words(part.column(1).to_pylist())
            text, place = _candidates(words, before or 0, target, part.column(2) if before else None)
            if n < target:
                found = _distinct(text, least_of(words.hashes(n, 0), target - n + 1)[place])
            else:
                found = _distinct(text, words.hashes(n, 0)[place], words.hashes(n, 1)[place])
            if len(found[0]):
                ids = part.column(0).to_numpy()[found[0]]
                cols = {"id": pa.array(ids, pa.int64())} | {c: pa.array(h.view(np.int64)) for c, h in zip("ab", found[1:], strict=False)}
                yield pa.RecordBatch.from_pydict(cols)


def without_windows(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """Columns id, text, the lost windows' first lanes and the rest: the texts without the words that these cover."""
    for batch in batches:
        for part in row_slices(batch, 1, SLICE_BYTES):
            texts = [(t or b"").split() for t in part.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            spans: list[list[dict]] = [[] for _ in texts]
            n_removed = np.zeros(len(texts), np.int64)
            hit = np.flatnonzero(part.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            if len(hit):
                some = part.take(pa.array(hit))
                words = Words(some.column(1).to_pylist())
                lists = some.column(2)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                text, place = words.windows(target)
                lost = place[_members(text, words.hashes(target, 0)[place], of, flat)]
                turns = np.zeros(int(words.sizes.sum()) + 1, np.int64)
                np.add.at(turns, lost, 1)
                np.add.at(turns, lost + target, -1)
                gone = np.cumsum(turns[:-1]) > 0
                for j, (i, start, size) in enumerate(zip(hit.tolist(), words.starts.tolist(), words.sizes.tolist(), strict=True)):
                    own = gone[start:start + size]
                    edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2).tolist()
                    spans[i] = [{"first": a, "end": b} for a, b in edges]
                    n_removed[i] = int(own.sum())
                    texts[i] = [w for a, b in zip([0, *[e[1] for e in edges]], [*[e[0] for e in edges], size], strict=True) for w in texts[i][a:b]]
            out = {"id": part.column(0), "kept": pa.array([b" ".join(t) for t in texts], pa.binary()), "n_words": pa.array(sizes),
                   "n_removed": pa.array(n_removed), "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_pydict(out | {c: part.column(c) for c in part.schema.names[3:]})


def repeated(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The windows that two documents hold: their least document ``lo`` and number of rows ``n``, stored."""
    return stored(found.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
                  .filter("lo < hi").drop("hi"), "op13-repeated")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = 50, least: int = 25,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, removed)``, a row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Each word is removed that is covered by
    a window of ``target`` words whose sequence also stands in a document with a
    smaller id; windows are judged on the input. ``text`` is the words kept, joined by
    one space, ``removed`` the spans of words that went (first, end). ``least`` is the
    shortest window length worth counting and changes no result.
    ``carry`` names columns to return with each row, as ``rest``, a struct.

    Defined cases: a null or empty text has no words and gives an empty one; texts
    shorter than the window lose nothing. Rows that repeat an id are one document: they take nothing
    from each other and lose the same windows; each stays a row. Null ids are one document
    below all others. Texts are read whole, other columns are ignored, an empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("binary").alias("body"),
                       *([F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []))
    plain = base.select("id", "body")
    steps, before, lists = lengths(target, least), None, None
    drops = docs.sparkSession.createDataFrame([], "drop_id long, drops array<bigint>")
    for n in steps:
        keys = ["a", "b"] if n == target else ["a"]
        source = plain if before is None else plain.join(lists, "id")
        schema = ", ".join(f"{c} long" for c in ["id", *keys])
        found = stored(source.mapInArrow(lambda it, before=before, n=n: windows_of(it, before, n, target), schema), "op13-windows")
        left = repeated(found, keys)
        if left.isEmpty():
            break
        back = join_counted(found, left, keys, "n", found.count())
        if n == target:
            drops = stored(back.filter("id > lo").groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("a").alias("drops")), "op13-drops")
        else:
            lists = stored(back.groupBy("id").agg(F.collect_set("a").alias("left")), "op13-lists")
            before = n
        discard(found, left)
    joined = base.join(drops, F.col("id") == F.col("drop_id"), "left").select("id", "body", "drops", *(["rest"] if carry else []))
    schema = "id long, kept binary, n_words long, n_removed long, removed array<struct<first:int,end:int>>"
    out = joined.mapInArrow(lambda it: without_windows(it, target), schema + (f", rest {base.schema['rest'].dataType.simpleString()}" if carry else ""))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("kept").cast("string").alias("text"),
                      "n_words", "n_removed", "removed", *(["rest"] if carry else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50) x),
f AS (SELECT h, min(doc_id) AS lo FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE doc_id > lo),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n_removed
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
