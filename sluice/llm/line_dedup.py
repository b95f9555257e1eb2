"""Line dedup with two Bloom filters: lines seen once, lines seen twice.

1. Every scan task puts the hashes of its documents' long lines into a pair of
   Bloom filters of ``2**filter_bits`` bits: a hash that the first already
   holds goes into the second. The tasks' filters are merged block by block
   (what two tasks both saw once was seen twice), in two levels so that no
   group holds the blocks of all tasks. The merged second filter has a size
   set by the parameter, and is broadcast.
2. A second scan probes it. Only lines that it holds, suspected repeats, leave
   the scan, as (document, 128-bit digest). They are confirmed exactly: the
   documents of each digest are counted, map-side first, and the keeping
   document is chosen.
3. Documents get the digests that they lose, and drop those lines. Only this
   step shuffles texts, once.

A filter too small for its corpus lets more lines pass as suspects; the result
stays exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import giving_back, read_table, row_slices, stored

KEY = "op3_line_dedup"

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK_WORDS = 8192
SLICE_BYTES = 4_000_000
LANES = 64


def long_keys(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has ``min_chars`` code points or more."""
    out = []
    for i, line in enumerate((text or b"").translate(LOWER).split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars and (key.isascii() or len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                out.append((i, key))
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _place(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash has four bits, all in one 64-bit word."""
    one = np.uint64(1)
    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return (h >> np.uint64(64 - (words.bit_length() - 1))).astype(np.int64), mask


def _hold(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, mask = _place(h, len(filt))
    return (filt[at] & mask) == mask


def _put(filt: np.ndarray, h: np.ndarray) -> None:
    if len(h):
        at, mask = _place(h, len(filt))  # h is sorted, so equal words are neighbours
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        filt[at[first]] |= np.bitwise_or.reduceat(mask, first)


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint64)


def _blocks(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in range(0, len(once), BLOCK_WORDS):
        part = once[b:b + BLOCK_WORDS]
        if part.any():
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([b // BLOCK_WORDS], pa.int32()), "once": [_packed(part)],
                "twice": [_packed(twice[b:b + BLOCK_WORDS])]})


def filters_of(batches: Iterator[pa.RecordBatch], bits: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one task's two filters."""
    once, twice = np.zeros(1 << (bits - 6), np.uint64), np.zeros(1 << (bits - 6), np.uint64)
    for batch in batches:
        for part in row_slices(batch, 0, SLICE_BYTES):
            h = [x for t in part.column(0).to_pylist() for x in {xxhash.xxh3_64_intdigest(k) for _, k in long_keys(t, min_chars)}]
            u, n = np.unique(np.array(h, np.uint64), return_counts=True)
            _put(twice, u[(n > 1) | _hold(once, u)])
            _put(once, u)
    yield from _blocks(once, twice)


def merge_blocks(table: pa.Table) -> pa.Table:
    once = twice = np.uint64(0)
    for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
        x, y = _unpacked(a), _unpacked(b)
        once, twice = once | x, twice | y | (once & x)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                     "once": pa.array([_packed(once)], pa.binary()), "twice": pa.array([_packed(twice)], pa.binary())})


def seen_twice(lines_of: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The second filter over all documents: ``2**bits`` bits, whatever the input."""
    schema = "block int, once binary, twice binary"
    made = lines_of.mapInArrow(giving_back(lambda it: filters_of(it, bits, min_chars)), schema)
    lanes = made.withColumn("lane", F.spark_partition_id() % LANES).groupBy("block", "lane").applyInArrow(
        lambda t: merge_blocks(t.select(["block", "once", "twice"])), schema)
    filt = np.zeros(1 << (bits - 6), np.uint64)
    for r in lanes.groupBy("block").applyInArrow(merge_blocks, schema).select("block", "twice").collect():
        filt[r.block * BLOCK_WORDS:(r.block + 1) * BLOCK_WORDS] = _unpacked(bytes(r.twice))
    return filt


def suspects_of(batches: Iterator[pa.RecordBatch], filt: np.ndarray, min_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest) of a document's distinct lines that the filter holds."""
    for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE_BYTES)):
        ids, keys = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {k for _, k in long_keys(t, min_chars)}
            keys += own
            ids += [i] * len(own)
        held = np.flatnonzero(_hold(filt, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
        if len(held):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[j] for j in held], pa.int64()),
                                              "key": pa.array([digest(keys[j]) for j in held], pa.binary())})


def without_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE_BYTES)):
        texts, n_lines, n_dropped = [], [], []
        for t, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            t = t or b""
            n_lines.append(t.count(b"\n") + 1)
            gone: set[int] = set()
            if drops:
                lost = set(drops)
                gone = {i for i, k in long_keys(t, min_chars) if digest(k) in lost}
                t = b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in gone)
            texts.append(t)
            n_dropped.append(len(gone))
        out = {"doc_id": batch.column(0), "kept": pa.array(texts, pa.binary()),
               "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.RecordBatch.from_pydict(out | {n: batch.column(n) for n in batch.schema.names[3:]})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, filter_bits: int = 27, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped)`` with repeated lines dropped, a row per input row.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except in the largest id holding them.
    ``carry`` names columns to return with each row, as ``rest``, a struct.

    Defined cases: a null or empty text is one empty line; the result's text is
    never null. Rows that repeat an id are one document: they count once, keep
    or lose lines alike, and each stays a row. Null ids are one document that
    ranks below all others. Other columns are ignored, an empty table gives no rows.
    """
    bits = max(filter_bits, 6 + (BLOCK_WORDS.bit_length() - 1))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"),
                       *([F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []))
    filt = docs.sparkSession.sparkContext.broadcast(seen_twice(base.select("body"), bits, min_chars))
    suspects = stored(base.select("doc_id", "body").mapInArrow(
        giving_back(lambda it: suspects_of(it, filt.value, min_chars)), "doc_id long, key binary"), "op3-suspects")
    # a table of its own: both sides of the join below are then shuffles of their own, and AQE can split a hot line
    repeated = stored(suspects.groupBy("key")
                      .agg(F.countDistinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("keeper"))
                      .filter(F.col("n") >= min_docs).select("key", "keeper"), "op3-repeated")
    drops = (suspects.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("key").alias("drops")))
    joined = base.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    rest = [f"rest {base.schema['rest'].dataType.simpleString()}"] if carry else []
    out = joined.select("doc_id", "body", "drops", *(["rest"] if carry else [])).mapInArrow(
        giving_back(lambda it: without_lines(it, min_chars)), ", ".join(["doc_id long, kept binary, n_lines long, n_dropped long", *rest]))
    return out.select("doc_id", F.col("kept").cast("string").alias("text"), "n_lines", "n_dropped", *(["rest"] if carry else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
r AS (SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 40
      GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS dropped
      FROM k LEFT JOIN r USING (line_key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
