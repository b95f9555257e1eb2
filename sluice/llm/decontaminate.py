"""Benchmark decontamination by latent semantic retrieval and alignment.

1. One scan keeps the hashed terms of all passages of the whole corpus and of all
   items; from them it is counted in how many passages each term occurs.
2. Randomised SVD of the TF-IDF passages, all of them, in two Spark jobs: tasks add
   up their passages with random signs, then multiply them with the broadcast basis,
   and the results are summed by blocks of terms. They have ``TERMS`` x at most
   2 x (``rank`` + 16) numbers, whatever the input.
3. A second scan projects every window of every document, at the window lengths
   the items need, and compares it with all items: cosine at least ``cosine``.
4. Candidates are verified on the words around the window: the longest common
   subsequence with the item must cover ``lcs`` of it, and its answer, the last
   sentence, must be covered by ``answer``. This finds copies and paraphrases.

Items are the stated query set. They are read in blocks of about ``block_items``,
each compared with all documents, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import discard, giving_back, read_table, stored, word_hashes

KEY = "op4_decontaminate"

TERMS = 1 << 15
PASSAGE = 64  # words of a passage for the statistics, and the longest part of an item
SIZES = (16, 32, 64)  # words of a window
BLOCK_TERMS = 1024
BATCH_BYTES = 100_000
DENSE = 32  # passages multiplied at a time
WORD_BITS = 1 << 11  # of an item's words, by a hash
CANDIDATES = 2048  # windows and items looked at together


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(TERMS)).astype(np.int64)


def word_bits(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) % WORD_BITS


def words_of(text: bytes | None) -> list[int]:
    """A text's words, as their hashes."""
    return word_hashes([text])[0].tolist()


def word_batches(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of all rows, number of words of each row) of consecutive rows with about BATCH_BYTES together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BATCH_BYTES or i == len(texts) - 1:
            yield first, *word_hashes(texts[first:i + 1])
            first, size = i + 1, 0


_TERM = np.random.default_rng(11).integers(0, 1 << 63, TERMS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def term_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each passage and how often it holds them."""
    for batch in batches:
        for _, words, sizes in word_batches(batch.column(0).to_pylist()):
            passages = -(-sizes // PASSAGE)
            own = np.repeat(np.cumsum(passages) - passages, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PASSAGE
            held, tf = np.unique(own * TERMS + terms_of(words), return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(held // TERMS, minlength=passages.sum()))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, (held % TERMS).astype(np.int16)), pa.ListArray.from_arrays(ends, tf.astype(np.int8))],
                                             ["terms", "counts"])


def count_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, passages that hold it); the term TERMS counts all passages."""
    n = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        n[:TERMS] += np.bincount(np.asarray(batch.column(0).flatten()), minlength=TERMS)
        n[TERMS] += batch.num_rows
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["term", "n"])


def inverse_frequency(passages: DataFrame) -> np.ndarray:
    out = np.zeros(TERMS + 1)
    for r in passages.select("terms").mapInArrow(giving_back(count_passages), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return np.log((1 + out[TERMS]) / (1 + out[:TERMS])).astype(np.float32) + np.float32(0.1)


def passage_rows(batch: pa.RecordBatch, idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of terms, terms, weights, hashes) of passages: their numbers or, with ``idf``, their counts times these at unit length."""
    sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
    sizes = sizes[sizes > 0]
    t, w = np.asarray(batch.column(0).flatten()).astype(np.int64), np.asarray(batch.column(1).flatten()).astype(np.float32)
    if not len(sizes):
        return sizes, t, w, t
    starts = np.cumsum(sizes) - sizes
    h = np.add.reduceat(_TERM[t] * w.view(np.uint32), starts)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    if idf is not None:
        w *= idf.value[t]
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), sizes)
    return sizes, t, w, h ^ (h >> np.uint64(29))


def blocks_of(out: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in range(0, TERMS, BLOCK_TERMS):
        if (part := out[b:b + BLOCK_TERMS]).any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])


def add_signed(batches: Iterator[pa.RecordBatch], n: int, idf) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of A' S, for the passages A of a task and S, which adds each of them, by its hash with either sign, to one of ``n`` sums."""
    out = np.zeros(TERMS * n, np.float32)
    for batch in batches:
        sizes, t, w, h = passage_rows(batch, idf)
        sign = np.where(h & np.uint64(1), np.float32(-1), np.float32(1))
        np.add.at(out, t * n + np.repeat(((h >> np.uint64(8)) % np.uint64(n)).astype(np.int64), sizes), w * np.repeat(sign, sizes))
    yield from blocks_of(out.reshape(TERMS, n))


def multiply(batches: Iterator[pa.RecordBatch], basis, idf) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of A' A M, for the passages A of a task and the basis M; a few passages at a time are a dense matrix over their terms."""
    m = basis.value
    out, place = np.zeros(m.shape, np.float32), np.zeros(TERMS, np.int64)
    for batch in batches:
        sizes, t, w, _ = passage_rows(batch, idf)
        ends = np.r_[0, np.cumsum(sizes)]
        for a in range(0, len(sizes), DENSE):
            own, some = sizes[a:a + DENSE], slice(ends[a], ends[min(a + DENSE, len(sizes))])
            place[t[some]] = 1
            held = np.flatnonzero(place)
            place[held] = np.arange(len(held))
            rows = np.zeros((len(own), len(held)), np.float32)
            rows[np.repeat(np.arange(len(own)), own), place[t[some]]] = w[some]
            out[held] += rows.T @ (rows @ m[held])
            place[held] = 0
    yield from blocks_of(out)


def add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, np.float32) for p in table.column("part").to_pylist())
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def summed(passages: DataFrame, parts, width: int) -> np.ndarray:
    """Terms x width: the sum of what ``parts`` gives for the passages of each task."""
    out = np.zeros((TERMS, width))
    schema = "block int, part binary"
    for r in passages.mapInArrow(giving_back(parts), schema).groupBy("block").applyInArrow(add_blocks, schema).collect():
        out[r.block:r.block + BLOCK_TERMS] = np.frombuffer(bytes(r.part), np.float32).reshape(-1, width)
    return out


def randomised_svd(passages: DataFrame, rank: int, extra: int = 16, idf=None) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of the passages, from two reads of all of them.

    The first adds them up with random signs to twice as many sums as there are
    columns in the basis, which are the sums' leading directions. The second multiplies the
    basis with A' A, which gives A' A on the product's range (Nystrom).
    """
    n = 2 * (rank + extra)
    q = np.linalg.svd(summed(passages, lambda it: add_signed(it, n, idf), n), full_matrices=False)[0][:, :rank + extra]
    b = passages.sparkSession.sparkContext.broadcast(q.astype(np.float32))
    wide = summed(passages, lambda it: multiply(it, b, idf), rank + extra)
    small = q.T @ wide
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    held = values > max(1e-6 * values[-1], 1e-12)
    v, sigma, _ = np.linalg.svd(wide @ (vectors[:, held] / np.sqrt(values[held])), full_matrices=False)
    best = np.flatnonzero(sigma[:rank] ** 2 > 1e-6)
    return v[:, best], sigma[best]


# search and verification


def common_subsequence(item: dict[int, int], n: int, words: list[int]) -> int:
    """Bits of the item's words (at most n) that a longest common subsequence with ``words`` takes."""
    v = full = (1 << n) - 1
    for w in words:
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Item:
    """A part of a benchmark item, of at most PASSAGE words."""

    def __init__(self, item_id, words: list[int], answer: list[int]):
        self.id, self.n, self.answer = item_id, len(words), answer
        self.words, self.masks, self.answer_masks = words, self.bits(words), self.bits(answer)
        self.distinct, self.repeats = frozenset(words), len(words) - len(self.masks)
        self.size = next(s for s in SIZES if s >= min(len(words), PASSAGE))

    @staticmethod
    def bits(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def need(self, lcs: float) -> int:
        return max(math.ceil(lcs * self.n - 1e-9), min(self.n, 6))

    def verified(self, words: list[int], lcs: float, answer: float) -> tuple[float, float] | None:
        """The shares of the item and of its answer that ``words`` cover, if these are enough."""
        need = self.need(lcs)
        if len(self.distinct.intersection(words)) + self.repeats < need:  # no more than the words they share, and the item's repeats
            return None
        got = common_subsequence(self.masks, self.n, words)
        if got < need:
            return None
        told = common_subsequence(self.answer_masks, len(self.answer), words) / len(self.answer)
        return (got / self.n, told) if told >= answer else None


def items_of(rows) -> list[Item]:
    """Parts of items; the answer of a part is its last sentence, of three words at least."""
    out = []
    for item_id, text in rows:
        sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if (w := words_of(s.encode()))]
        words = [w for s in sentences for w in s]
        answer = sentences[-1] if sentences and len(sentences[-1]) >= 3 else words[-max(3, len(words) // 4):]
        for a in range(0, len(words), PASSAGE):
            part = words[max(0, min(a, len(words) - PASSAGE)):][:PASSAGE]
            out.append(Item(item_id, part, answer[-PASSAGE:] if a + PASSAGE >= len(words) else part[-16:]))
    return out


class Searcher:
    def __init__(self, items: list[Item], vectors: np.ndarray, cosine: float, lcs: float, answer: float):
        self.items, self.vectors = items, np.vstack([vectors, np.zeros_like(vectors[:1])])  # terms x rank, and a row of padding
        self.cosine, self.lcs, self.answer = cosine, lcs, answer
        self.by_size = {}
        for size in SIZES:
            own = [i for i, x in enumerate(items) if x.size == size]
            if own:
                v = np.array([vectors[terms_of(np.array(items[i].words, np.uint64))].sum(0) for i in own])
                n = np.array([items[i].n for i in own])
                held = _bit_sets(word_bits(np.array([w for i in own for w in items[i].words], np.uint64)), np.repeat(np.arange(len(own)), n), len(own))
                # shared bits that are enough: words that share a bit, or repeat, are as many as the item has more words than bits
                needs = np.array([items[i].need(lcs) for i in own]) - n + np.bitwise_count(held).sum(1, dtype=np.int64)
                self.by_size[size] = ([items[i] for i in own], needs, _unit(v).T.copy(), held)

    def search(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int, int]]:
        """(text, item id, cosine, covered, answer covered, first word, word behind the last), the best place of each part in each text.

        ``words`` are the texts' words, one text after the other, ``sizes`` their
        numbers. Each text is padded to whole windows; what a window that runs into
        the next text finds is verified on its own text only.
        """
        begins = np.cumsum(sizes) - sizes
        room = -(-sizes // SIZES[-1]) * SIZES[-1]
        starts = np.cumsum(room) - room
        if not room.sum():
            return
        t = np.full(room.sum(), TERMS)
        t[np.arange(len(words)) + np.repeat(starts - begins, sizes)] = terms_of(words)
        unit, rank = SIZES[0] // 2, self.vectors.shape[1]
        t = t.reshape(-1, unit)
        sums = self.vectors[t[:, 0]]
        for i in range(1, unit):
            sums += self.vectors[t[:, i]]
        bits = word_bits(words)
        best: dict[tuple[int, int], tuple] = {}  # by text and item part
        for size in SIZES:
            if size in self.by_size:
                own, needs, m, held = self.by_size[size]
                windows = sums.copy()
                windows[:-1] += sums[1:]
                cos = _unit(windows) @ m
                at, which = np.nonzero(cos >= self.cosine)
                of = np.searchsorted(starts, at * unit, "right") - 1
                a = at * unit - starts[of]
                lo, hi = np.maximum(0, a - unit - 4), np.minimum(sizes[of], a + size + unit + 4)
                full = np.flatnonzero(_shared_bits(held, which, at, bits, begins[of] + lo, begins[of] + hi) >= needs[which])
                last = -1
                for k, j, d, lo, hi in zip(*(x[full].tolist() for x in (at, which, of, lo, hi)), strict=True):
                    if k != last:  # one window's candidates follow each other
                        near, last = words[begins[d] + lo:begins[d] + max(lo, hi)].tolist(), k
                    item = own[j]
                    got = item.verified(near, self.lcs, self.answer)
                    if got and ((d, id(item)) not in best or got[0] > best[d, id(item)][2]):
                        best[d, id(item)] = (item.id, float(cos[k, j]), *got, lo, hi)
            unit *= 2
            sums = sums.reshape(-1, 2, rank).sum(1)
        for (d, _), found in best.items():
            yield d, *found


def _bit_sets(bits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, WORD_BITS), bool)
    out[row, bits] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _shared_bits(held: np.ndarray, item: np.ndarray, window: np.ndarray, bits: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bits of its words each item shares with the words from ``begin`` to ``end``, the same places for the same window."""
    out = np.zeros(len(item), np.int64)
    for i in range(0, len(item), CANDIDATES):
        some = slice(i, i + CANDIDATES)
        new = np.r_[True, window[some][1:] != window[some][:-1]]
        a, n = begin[some][new], np.maximum(end[some][new] - begin[some][new], 0)
        row = np.repeat(np.arange(len(n)), n)
        near = _bit_sets(bits[np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)], row, len(n))
        out[some] = np.bitwise_count(near[np.cumsum(new) - 1] & held[item[some]]).sum(1)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def search_batches(batches: Iterator[pa.RecordBatch], searcher) -> Iterator[pa.RecordBatch]:
    s = searcher.value
    for batch in batches:
        rows, docs = [], batch.column(0).to_pylist()
        for first, words, sizes in word_batches(batch.column(1).to_pylist()):
            rows += [(docs[first + found[0]], *found[1:]) for found in s.search(words, sizes)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         ["doc_id", "item_id", "cosine", "covered", "answer_covered", "first_word", "last_word"])


FOUND = "doc_id long, item_id long, cosine double, covered double, answer_covered double, first_word long, last_word long"


def latent_vectors(docs: DataFrame, bench: DataFrame, rank: int) -> np.ndarray:
    """Terms x rank: idf-weighted singular vectors of all passages, each direction scaled to unit variance."""
    texts = docs.select("text").unionByName(bench.select("text"))
    passages = stored(texts.mapInArrow(giving_back(term_passages), "terms array<smallint>, counts array<tinyint>"), "op4-passages")
    idf = inverse_frequency(passages)
    v, sigma = randomised_svd(passages, rank, idf=docs.sparkSession.sparkContext.broadcast(idf))
    discard(passages)
    return (idf[:, None] * v / sigma).astype(np.float32)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", rank: int = 64, cosine: float = 0.4, lcs: float = 0.7,
                  answer: float = 0.5, block_items: int = 20_000) -> DataFrame:
    """The benchmark items found in documents.

    One row for each document and item found in it, at its best place: ``(doc_id,
    item_id, cosine, covered, answer_covered, first_word, last_word)``; words are
    numbered from 0 and the place is half-open.

    Defined cases: null and empty texts and items hold nothing and are found
    nowhere. Items of fewer than six words must be found whole. Rows that repeat
    an id are searched each, and an item found in several of them is one row, at
    the best place. A null id is an id. Long texts are searched whole. Other
    columns are ignored; an empty table on either side gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    spark = docs.sparkSession
    blocks = -(-items.count() // block_items)
    parts = []
    vectors = latent_vectors(base, items.withColumn("text", F.col("text").cast("binary")), rank) if blocks else None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        searcher = spark.sparkContext.broadcast(Searcher(items_of([(r.item_id, r.text) for r in part.collect()]), vectors, cosine, lcs, answer))
        parts.append(base.mapInArrow(giving_back(lambda it, s=searcher: search_batches(it, s)), FOUND))
    # an empty table made in Python has tasks of its own, which start further Python processes in the executors
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)
    best = F.max(F.struct("covered", "cosine", "answer_covered", "first_word", "last_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.cosine", "best.covered", "best.answer_covered", "best.first_word", "best.last_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = None
