"""Katz backoff language model: partitioned tables, evaluated per token.

The model is a bigram model over all words of the training rows. Each has its own
probability and its own history; the words never seen in training share theirs equally.

1. Words: one scan counts every distinct word of the training rows (tasks send
   sorted arrays of 64-bit word hashes, one for each bucket). The merged table of
   counts, by bucket, stays in the shared folder.
2. Bigrams: a second scan counts the training bigrams in the same way. The most
   frequent words are known to all tasks by number. A bigram of two such words has
   a key of their numbers, any other one a hash of its words, which it carries
   along. Bigrams after a frequent word are spread by their key, those after any
   other word by that word: all that follows it is then in the bucket of the word
   itself. A bigram that ends in another word asks that word's bucket for its count.
   From the merged table come the Good-Turing discounts (counts of counts) and for
   each history its discounted mass and the mass of its seen words. Only those of
   the frequent words reach the driver, an array of bounded size; each bucket makes
   its own words' from its part of the table.
3. Scoring: a third scan cuts all texts into tokens. What the broadcast part of
   the model decides (frequent words, and the ``hot`` most frequent bigrams of them)
   is summed where it is read; so a frequent word or pair is never sent. Other words
   and bigrams go to their bucket as postings, each distinct one once for a block
   of documents, and meet the table there. What a bucket adds to a block's
   documents comes back as one row, and the block adds it up.

P(w | h) is d(c) c / c(h) for a bigram seen c times, else alpha(h) P(w). d(c) is
Katz's discount for c up to 5, from the counts of counts. alpha(h) is what h's
discounted counts leave, over the lower-order mass of words not seen after h, so
each history's probabilities sum to 1. P(w) is c(w) / (N + g); g is the number of
words seen once (1 at least), and g / (N + g) the Good-Turing mass of all unseen words. They are
taken to be as many as Chao estimates from the words seen once and twice, n1^2 / (2 n2)
(n1 (n1 - 1) / 2 without the latter, 1 at least), and each has an equal part. A text's score is summed as log P(w) + log alpha(w) over its words
(each is a history once), and for each bigram seen in training what its own
probability differs from that; so a word and a bigram are looked up apart.

``fit(vocabulary=n)`` gives the closed model instead, of the ``n`` most frequent
words and one symbol for all others, seen or not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import crc_mod, discard, giving_back, read_table, row_slices, stored

KEY = "op2_katz_lm"

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"  # no word holds white space
BLOCK_TOKENS = 2_000_000
SLICE_BYTES = 1_000_000
CACHE_WORDS = 200_000
MAX_DISCOUNTED = 5


def tokens(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, the end token last."""
    w = (text or b"").translate(LOWER).split()
    w.append(END)
    return w


class WordHashes:
    """64-bit hashes of words, and what ``ids_of`` makes of them; kept for the words met last, which are numbered as they come."""

    def __init__(self, ids_of=lambda h: h):
        self.ids_of = ids_of
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)
        self.ids = self.ids_of(self.hashes)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and ids of all texts' tokens, and each text's number of tokens."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        words = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        new = list(islice(self.number, len(self.hashes), None))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        self.hashes, self.ids = np.append(self.hashes, h), np.append(self.ids, self.ids_of(h))
        return self.hashes[at], self.ids[at], sizes


def text_slices(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in row_slices(batch, col, SLICE_BYTES))


def before(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; ``start`` before the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


ZSTD = pa.Codec("zstd", 1)


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number."""
    return a.nbytes.to_bytes(8, "little") + ZSTD.compress(np.ascontiguousarray(a).tobytes(), asbytes=True)


def unpack(b, kind) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little")), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences, byte planes apart, so that the high bytes shrink."""
    d = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return pack(d.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(b) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    first = firsts(keys[order])
    return keys[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def firsts(keys: np.ndarray) -> np.ndarray:
    """The first position of each of the ascending keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in ascending order) of each bucket that has keys."""
    if not len(keys):
        return
    yield from by_place(spread(keys, buckets))


def by_place(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in ascending order) of keys whose buckets are ``b``."""
    if not len(b):
        return
    order = np.argsort(b.astype(np.uint16) if b.max() < 1 << 16 else b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order], prepend=-1))
    for a, z in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(b[order[a]]), order[a:z]


COUNTS = "bucket int, keys binary, counts binary"


def count_rows(keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    parts = [(b, pack_sorted(keys[at]), pack(n[at])) for b, at in by_bucket(keys, buckets)]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *[pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2)]],
                                      ["bucket", "keys", "counts"])


def merge_counts(table: pa.Table) -> pa.Table:
    keys = np.concatenate([unpack_sorted(b) for b in table.column("keys").to_pylist()])
    n = np.concatenate([unpack(b, np.int64) for b in table.column("counts").to_pylist()])
    keys, n = summed(keys, n)
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([pack_sorted(keys)], pa.binary()),
                     "counts": pa.array([pack(n)], pa.binary())})


class Counter:
    """Sums keys in blocks, so that a task holds a block's keys and no more."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size >= BLOCK_TOKENS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            u, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.size = [], 0
            yield count_rows(u, n, self.buckets)


def count_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, counter = WordHashes(), Counter(buckets)
    for part in text_slices(batches, 0):
        yield from counter.add(hashes.of(part.column(0).to_pylist())[0])
    yield from counter.flush()


class Vocabulary:
    """Words by number: 0 to size - 1 as hashes ascend, then the other words, then the start of a text."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, singles: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.size, self.total, self.distinct = len(hashes), total, distinct
        self.other, self.start = self.size, self.size + 1
        g = max(1, singles)
        self.p = np.append(self.counts, total - self.counts.sum() + g) / (total + g)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(h), self.other)
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        return np.where(self.hashes[at] == h, at, self.other)

    def bigrams(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of the bigrams that end at each token of texts of ``sizes`` tokens."""
        return before(numbers, sizes, self.start).astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def count_bigrams(batches: Iterator[pa.RecordBatch], vocab, buckets: int) -> Iterator[pa.RecordBatch]:
    v = vocab.value
    hashes, counter = WordHashes(v.numbers), Counter(buckets)
    for part in text_slices(batches, 0):
        _, numbers, sizes = hashes.of(part.column(0).to_pylist())
        yield from counter.add(v.bigrams(numbers, sizes))
    yield from counter.flush()


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's d(c) for c = 0 to MAX_DISCOUNTED, the last for all larger c too; d is 1 where the counts of counts give none."""
    n = [counts_of_counts.get(c, 0) for c in range(MAX_DISCOUNTED + 2)]
    d = np.ones(MAX_DISCOUNTED + 2)
    if n[1]:
        top = (MAX_DISCOUNTED + 1) * n[MAX_DISCOUNTED + 1] / n[1]
        for c in range(1, MAX_DISCOUNTED + 1):
            if n[c] and top < 1:
                x = ((c + 1) * n[c + 1] / (c * n[c]) - top) / (1 - top)
                d[c] = x if 0 < x <= 1 else 1
    return d


def weights(history: np.ndarray, discounted: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories' scale of discounted counts, and alpha; from count, sum of discounted counts, lower-order mass of seen words."""
    rest = np.maximum(1 - seen, 0)
    full = rest < 1e-12  # every word was seen after it: nothing is left to back off to
    kept = discounted / np.maximum(history, 1)
    # a history none of whose counts are discounted keeps one part in c + 1 for unseen words
    scale = np.where(full, 1 / np.maximum(kept, 1e-300), np.where(kept > 1 - 1e-12, history / (history + 1), 1.0))
    scale = np.where(history > 0, scale / np.maximum(history, 1), 0.0)
    return scale, np.where(history > 0, np.where(full, 0.0, (1 - scale * discounted) / np.where(full, 1, rest)), 1.0)


class Backoff:
    """Probabilities of bigrams; arrays over the histories."""

    def __init__(self, vocab: Vocabulary, d: np.ndarray, history: np.ndarray, discounted: np.ndarray, seen: np.ndarray):
        """By history: its count, the sum of its discounted counts, the lower-order mass of its seen words."""
        self.d, self.p = d, vocab.p
        self.scale, self.alpha = weights(history, discounted, seen)

    def log_p(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(w | h), by backoff to the words' own probability where the bigram was not seen."""
        h, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seen = self.d[np.minimum(counts, MAX_DISCOUNTED + 1)] * counts * self.scale[h]
        return np.log10(np.where(counts > 0, seen, self.alpha[h] * self.p[w]))


HISTORIES = "history long, n long, discounted double, seen double"


def history_sums(batches: Iterator[pa.RecordBatch], vocab, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    v = vocab.value
    sums = np.zeros((3, v.size + 2))
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, n = unpack_sorted(k), unpack(c, np.int64)
            h, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for i, x in enumerate((n, d[np.minimum(n, MAX_DISCOUNTED + 1)] * n, v.p[w])):
                sums[i] += np.bincount(h, x, v.size + 2)
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at].astype(np.int64)), pa.array(sums[1, at]), pa.array(sums[2, at])],
                                     ["history", "n", "discounted", "seen"])


def exploded(batches: Iterator[pa.RecordBatch], largest: int, below: int | None) -> Iterator[pa.RecordBatch]:
    """(key, n) of the ``largest`` counts of each bucket; of keys less than ``below`` if given."""
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, n = unpack_sorted(k), unpack(c, np.int64)
            if below is not None:
                keys, n = keys[:np.searchsorted(keys, np.uint64(below))], n[:np.searchsorted(keys, np.uint64(below))]
            at = np.argpartition(-n, largest)[:largest] if len(n) > largest else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(n[at])], ["key", "n"])


def counts_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, keys with count c, their sum): for c above MAX_DISCOUNTED + 1 all together."""
    top = MAX_DISCOUNTED + 2
    n, total = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
    for batch in batches:
        for c in batch.column(0).to_pylist():
            x = unpack(c, np.int64)
            n += np.bincount(np.minimum(x, top), minlength=top + 1)
            total += np.bincount(np.minimum(x, top), x, top + 1).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(top + 1)), pa.array(n), pa.array(total)], ["c", "n", "total"])


def histogram(table: DataFrame) -> dict[int, tuple[int, int]]:
    rows = table.select("counts").mapInArrow(counts_of_counts, "c long, n long, total long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("total").alias("t"))
    return {r.c: (r.n, r.t) for r in rows.collect()}


def most_frequent(table: DataFrame, largest: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """At most ``largest`` keys and counts of a table, by count, ties by key; the keys ascend."""
    if not largest:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = table.select("keys", "counts").mapInArrow(lambda it: exploded(it, largest, below), "key long, n long")
    top = rows.orderBy(F.desc("n"), "key").limit(largest).toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


# the model of all words

COLD = np.uint64(1 << 63)  # keys of bigrams with a word that is not frequent
PAIR_COUNTS = "bucket int, keys binary, counts binary, h binary, w binary"
ASKED = "bucket int, origin int, keys binary"


class Words(Vocabulary):
    """All words: the frequent ones by number as in Vocabulary, any other by its hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, singles: int, doubles: int):
        super().__init__(hashes, counts, total, distinct, singles)
        self.mass = self.total + max(1, singles)
        # Chao's estimate of how many words there are besides those seen, which share the unseen mass
        self.unseen_words = max(1.0, singles**2 / (2 * doubles) if doubles else singles * (singles - 1) / 2)
        self.unseen = max(1, singles) / self.mass / self.unseen_words
        self.p = np.append(self.counts / self.mass, self.unseen)

    def ids(self, h: np.ndarray) -> np.ndarray:
        n = self.numbers(h)
        return np.where(n < self.size, n.astype(np.uint64), h)

    def cold(self, ids: np.ndarray) -> np.ndarray:
        return ids > np.uint64(self.start)

    def pairs(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and histories of the bigrams that end at each token of texts of ``sizes`` tokens."""
        h = before(ids, sizes, self.start)
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F) + ids
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) | COLD
        return np.where(self.cold(h) | self.cold(ids), mixed, h << np.uint64(32) | ids), h

    def place(self, keys: np.ndarray, h: np.ndarray, buckets: int) -> np.ndarray:
        return spread(np.where(self.cold(h), h, keys), buckets)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(np.where(counts > 0, counts / self.mass, self.unseen))


def pack_ids(a: np.ndarray) -> bytes:
    return pack(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)


def unpack_ids(b) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]


def pair_row(bucket: int, keys: np.ndarray, n: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple:
    """Bigrams by ascending key; those of frequent words, which come first, have both words in their key."""
    a = np.searchsorted(keys, COLD)
    return bucket, pack_sorted(keys), pack(n), pack_ids(h[a:]), pack_ids(w[a:])


def pair_arrays(row: dict) -> tuple[np.ndarray, ...]:
    """keys, counts, histories and words of a row."""
    keys, n = unpack_sorted(row["keys"]), unpack(row["counts"], np.int64)
    hot = keys[:np.searchsorted(keys, COLD)]
    return keys, n, np.r_[hot >> np.uint64(32), unpack_ids(row["h"])], np.r_[hot & np.uint64(0xFFFFFFFF), unpack_ids(row["w"])]


def arrow_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


def count_pairs(batches: Iterator[pa.RecordBatch], words, buckets: int) -> Iterator[pa.RecordBatch]:
    v = words.value
    hashes = WordHashes(v.ids)
    parts, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, h, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        cold = np.flatnonzero(keys >= COLD)
        cold = cold[np.argsort(keys[cold])]
        own = cold[firsts(keys[cold])]
        hot, n = np.unique(keys[keys < COLD], return_counts=True)
        # bigrams of frequent words have both in their key, and sort before the others
        u, n = np.append(hot, keys[own]), np.append(n, np.diff(np.append(firsts(keys[cold]), len(cold))))
        h, w = np.append(hot >> np.uint64(32), h[own]), np.append(hot & np.uint64(0xFFFFFFFF), w[own])
        return arrow_rows([pair_row(b, u[x], n[x], h[x], w[x]) for b, x in by_place(v.place(u, h, buckets))], PAIR_COUNTS)

    for part in text_slices(batches, 0):
        _, ids, sizes = hashes.of(part.column(0).to_pylist())
        keys, h = v.pairs(ids, sizes)
        parts.append((keys, h, ids))
        size += len(ids)
        if size >= BLOCK_TOKENS:
            yield flush()
            parts, size = [], 0
    if size:
        yield flush()


def merge_pairs(table: pa.Table) -> pa.Table:
    parts = [pair_arrays(r) for r in table.to_pylist()]
    keys, n, h, w = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.argsort(keys)
    first = firsts(keys[order])
    own = order[first]
    return pa.Table.from_batches([arrow_rows([pair_row(table.column("bucket")[0].as_py(), keys[own], np.add.reduceat(n[order], first), h[own], w[own])], PAIR_COUNTS)])


def ask_words(batches: Iterator[pa.RecordBatch], words, buckets: int) -> Iterator[pa.RecordBatch]:
    """The words, not frequent, that each bucket's bigrams end in, by the words' buckets."""
    v = words.value
    for batch in batches:
        for r in batch.to_pylist():
            w = np.unique(unpack_ids(r["w"]))
            w = w[v.cold(w)]
            yield arrow_rows([(b, r["bucket"], pack_sorted(w[at])) for b, at in by_bucket(w, buckets)], ASKED)


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray], default: float = 0) -> np.ndarray:
    """The table's values (its keys ascend) of ``keys``."""
    if not len(table[0]):
        return np.full(len(keys), default, table[1].dtype)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], table[1].dtype.type(default))


def answer_words(asked: pa.Table, words: pa.Table) -> pa.Table:
    """The counts of the words that bigrams' buckets asked for, by these buckets."""
    if not asked.num_rows:
        return pa.Table.from_batches([arrow_rows([], COUNTS)])
    (table,) = words.to_pylist()
    own = unpack_sorted(table["keys"]), unpack(table["counts"], np.int64)
    return pa.Table.from_batches([arrow_rows([(r["origin"], r["keys"], pack(looked_up(unpack_sorted(r["keys"]), own))) for r in asked.to_pylist()], COUNTS)])


def with_counts(pairs: pa.Table, answers: pa.Table, words) -> pa.Table:
    """Bigrams with the counts of the words they end in, instead of the words."""
    v, rows = words.value, []
    got = [(unpack_sorted(r["keys"]), unpack(r["counts"], np.int64)) for r in answers.to_pylist()]
    keys, n = (np.concatenate([g[i] for g in got] or [np.zeros(0, k)]) for i, k in enumerate((np.uint64, np.int64)))
    order = np.argsort(keys)
    for r in pairs.to_pylist():
        w = unpack_ids(r["w"])
        cold = v.cold(w)
        c = np.zeros(len(w), np.int64)
        c[cold] = looked_up(w[cold], (keys[order], n[order]))
        c[~cold] = v.counts[w[~cold].astype(np.int64)]
        rows.append((r["bucket"], r["keys"], r["counts"], r["h"], pack_ids(c)))
    return pa.Table.from_batches([arrow_rows(rows, PAIR_COUNTS)])


def pair_masses(row: dict, v: Words) -> tuple[np.ndarray, ...]:
    """keys, counts, histories of a row, and P(w) of the words that its bigrams end in; from ``with_counts``."""
    keys, n, h, w = pair_arrays(row)
    a = np.searchsorted(keys, COLD)
    return keys, n, h, np.r_[v.p[w[:a].astype(np.int64)], w[a:] / v.mass]


def frequent_sums(batches: Iterator[pa.RecordBatch], words, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums of the frequent histories."""
    v = words.value
    sums = np.zeros((3, v.size + 2))
    for batch in batches:
        for r in batch.to_pylist():
            _, n, h, p = pair_masses(r, v)
            own = ~v.cold(h)
            n, h, p = n[own], h[own].astype(np.int64), p[own]
            for i, x in enumerate((n, d[np.minimum(n, MAX_DISCOUNTED + 1)] * n, p)):
                sums[i] += np.bincount(h, x, v.size + 2)
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at].astype(np.int64)), pa.array(sums[1, at]), pa.array(sums[2, at])],
                                     ["history", "n", "discounted", "seen"])


class OpenBackoff(Backoff):
    """Scales and alphas of the frequent histories; those of the others are made in their buckets."""

    def __init__(self, v: Words, d: np.ndarray, history: np.ndarray, discounted: np.ndarray, seen: np.ndarray):
        super().__init__(v, d, history, discounted, seen)
        self.log_alpha = logs(self.alpha)
        #: what a frequent word adds to a score: as a word, and as a history
        self.token = np.log10(self.p[:-1]) + self.log_alpha[:v.size]

    def gain(self, n: np.ndarray, scale: np.ndarray, log_alpha: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How log P(w | h) of bigrams seen ``n`` times differs from log alpha(h) + log P(w)."""
        return np.log10(self.d[np.minimum(n, MAX_DISCOUNTED + 1)] * n * scale) - log_alpha - np.log10(p)

    def frequent_gain(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        h, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return self.gain(n, self.scale[h], self.log_alpha[h], self.p[w])

    def bucket(self, row: dict, v: Words) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of a bucket's bigrams: keys and gains, and its own histories with their log alphas."""
        keys, n, h, p = pair_masses(row, v)
        cold = v.cold(h)
        own, inverse = np.unique(h[cold], return_inverse=True)
        c = n[cold]
        scale, alpha = weights(*(np.bincount(inverse, x, len(own)) for x in (c, self.d[np.minimum(c, MAX_DISCOUNTED + 1)] * c, p[cold])))
        scales, log_alphas = np.empty(len(h)), np.empty(len(h))
        scales[cold], log_alphas[cold] = scale[inverse], logs(alpha)[inverse]
        known = h[~cold].astype(np.int64)
        scales[~cold], log_alphas[~cold] = self.scale[known], self.log_alpha[known]
        return (keys, self.gain(n, scales, log_alphas, p)), (own, logs(alpha))


def logs(alpha: np.ndarray) -> np.ndarray:
    """log10 of alphas; 0 for a history that backs off to nothing, all of whose bigrams are seen."""
    return np.log10(np.where(alpha > 0, alpha, 1.0))


class KatzModel:
    """Tables of counts in the shared folder, and the bounded part that tasks get."""

    def __init__(self, words: DataFrame, bigrams: DataFrame, vocab: Vocabulary, backoff: Backoff, hot: tuple[np.ndarray, np.ndarray], buckets: int):
        self.words, self.bigrams, self.vocab, self.backoff, self.hot, self.buckets = words, bigrams, vocab, backoff, hot, buckets


FREQUENT = 1 << 16


def fit(docs: DataFrame, text_col: str = "text", vocabulary: int | None = None, hot: int = 1 << 18, buckets: int | None = None,
        frequent: int = FREQUENT) -> KatzModel:
    """Model of the rows of ``docs``, of all their words or of ``vocabulary`` words and one symbol for the others.

    ``buckets`` are the parts of its tables, two for each shuffle partition unless
    given. ``frequent`` words and ``hot`` bigrams are known to all tasks; they bound
    memory, the model does not depend on them.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))

    def table(name: str, fn, merge=merge_counts, schema: str = COUNTS) -> DataFrame:
        return stored(texts.mapInArrow(giving_back(fn), schema).groupBy("bucket").applyInArrow(merge, schema), name)

    words = table("op2-words", lambda it: count_words(it, buckets))
    of = histogram(words)
    total, distinct = sum(t for _, t in of.values()), sum(n for n, _ in of.values())
    open_model = vocabulary is None
    top = most_frequent(words, frequent if open_model else vocabulary)
    once, twice = (of.get(c, (0, 0))[0] for c in (1, 2))
    vocab = Words(*top, total, distinct, once, twice) if open_model else Vocabulary(*top, total, distinct, once)
    vocab_b = spark.sparkContext.broadcast(vocab)
    if open_model:
        counted = table("op2-pairs", lambda it: count_pairs(it, vocab_b, buckets), merge_pairs, PAIR_COUNTS)
        asked = counted.select("bucket", "w").mapInArrow(lambda it: ask_words(it, vocab_b, buckets), ASKED)
        answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer_words, COUNTS)
        bigrams = stored(counted.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
            lambda a, b: with_counts(a, b, vocab_b), PAIR_COUNTS), "op2-bigrams")
        discard(counted)
    else:
        bigrams = table("op2-bigrams", lambda it: count_bigrams(it, vocab_b, buckets))
    d = discounts({c: n for c, (n, _) in histogram(bigrams).items()})
    sums = np.zeros((3, vocab.size + 2))
    if open_model:
        rows = bigrams.mapInArrow(lambda it: frequent_sums(it, vocab_b, d), HISTORIES)
    else:
        rows = bigrams.select("keys", "counts").mapInArrow(lambda it: history_sums(it, vocab_b, d), HISTORIES)
    got = rows.groupBy("history").agg(F.sum("n").alias("n"), F.sum("discounted").alias("discounted"), F.sum("seen").alias("seen")).toArrow()
    for i, name in enumerate(("n", "discounted", "seen")):
        sums[i, got.column("history").to_numpy()] = got.column(name).to_numpy()
    if not open_model:
        return KatzModel(words, bigrams, vocab, Backoff(vocab, d, *sums), most_frequent(bigrams, hot), buckets)
    backoff = OpenBackoff(vocab, d, *sums)
    keys, n = most_frequent(bigrams, hot, below=int(COLD))
    return KatzModel(words, bigrams, vocab, backoff, (keys, backoff.frequent_gain(keys, n)), buckets)


# scoring

WORDS, PAIRS, WHOLE = 0, 1, 2  # kinds of postings; the last are rows of documents, packed
POSTINGS = "block long, bucket int, kind int, keys binary, sizes binary, docs binary"
ROW_FIELDS = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n).astype(np.float64)  # of nothing, numpy counts in integers


class Slots:
    """Places of distinct keys by a table of hash slots: a slot has the first of its keys, and each of these the next."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, (4 * len(keys)).bit_length())
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        first = firsts(slot[order])
        self.first, self.next = np.full(1 << self.bits, -1, np.int32), np.full(len(keys), -1, np.int32)
        self.next[order[:-1]] = order[1:]
        self.next[order[np.append(first[1:], len(order))[:len(first)] - 1]] = -1
        self.first[slot[order[first]]] = order[first]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that the table does not hold."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.first[self.slot(keys)]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = self.next[at[left]]
            left = left[(at[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return at


class Block:
    """Documents of a task, and their tokens that the broadcast part of the model does not decide."""

    def __init__(self, vocab: Vocabulary, backoff: Backoff, slots: Slots, hot: np.ndarray, buckets: int, number: int):
        """``hot`` has the counts of the bigrams in ``slots``, or the open model's gains."""
        self.vocab, self.backoff, self.slots, self.hot, self.buckets, self.number = vocab, backoff, slots, hot, buckets, number
        self.left, self.rows, self.size, self.docs = [], [], 0, 0
        self.open = isinstance(vocab, Words)
        self.base = vocab.base(vocab.counts)

    def add(self, doc_ids: pa.Array, h: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> None:
        """Texts: their rows have tokens, known tokens, base and score as far as decided here."""
        v, n = self.vocab, len(sizes)
        row = np.repeat(np.arange(n, dtype=np.uint32), sizes)
        inside = numbers < v.size
        if self.open:
            keys, history = v.pairs(np.where(inside, numbers.astype(np.uint64), h), sizes)
        else:
            keys = v.bigrams(numbers, sizes)
        at = self.slots.places(keys)
        known = at >= 0
        places = v.place(keys[~known], history[~known], self.buckets) if self.open else spread(keys[~known], self.buckets)
        doc = row + np.uint32(self.docs)
        self.left.append((h[~inside], doc[~inside], keys[~known], doc[~known], places))
        base = row_sums(row[inside], self.base[numbers[inside]], n)
        if self.open:
            score = self.backoff.log_alpha[v.start] + row_sums(row[inside], self.backoff.token[numbers[inside]], n) + row_sums(row[known], self.hot[at[known]], n)
        else:
            score = row_sums(row[known], self.backoff.log_p(keys[known], self.hot[at[known]]), n)
        columns = pa.array(sizes), pa.array(np.bincount(row[inside], minlength=n)), pa.array(base), pa.array(score)
        self.rows.append(pa.RecordBatch.from_arrays([doc_ids, *columns], ROW_FIELDS))
        self.size += len(h)
        self.docs += n

    def postings(self) -> pa.RecordBatch:
        """Rows by bucket: distinct keys, how many documents each has, and these; and one row of the documents' rows."""
        rows = []
        words, word_docs, pairs, pair_docs, places = (np.concatenate([x[i] for x in self.left]) for i in range(5))
        for kind, keys, doc, place in ((WORDS, words, word_docs, spread(words, self.buckets)), (PAIRS, pairs, pair_docs, places)):
            order = np.argsort(keys)
            keys, doc = keys[order], doc[order]
            own = firsts(keys)
            size = np.diff(np.append(own, len(keys)))
            for b, at in by_place(place[order][own]):
                # the documents of the bucket's keys, one key after the other
                n = size[at]
                where = np.repeat(own[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                rows.append((b, kind, pack_sorted(keys[own][at]), _planes(n), _planes(doc[where])))
        rows.append((self.number % self.buckets, WHOLE, _ipc(self.rows), None, None))
        return pa.RecordBatch.from_arrays([pa.array([self.number] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(
            (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]], [f.split()[0] for f in POSTINGS.split(", ")])


def _planes(a: np.ndarray) -> bytes:
    return pack(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(b) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0].astype(np.int64)


def _ipc(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        for part in rows:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def read_texts(batches: Iterator[pa.RecordBatch], vocab, backoff, hot, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of what the tables must decide, block by block; blocks are numbered by task and place."""
    v, n = vocab.value, TaskContext.get().partitionId() << 28
    hashes, (keys, values) = WordHashes(v.numbers), hot.value
    slots = Slots(keys)
    block = Block(v, backoff.value, slots, values, buckets, n)
    for part in text_slices(batches, 1):
        block.add(part.column(0), *hashes.of(part.column(1).to_pylist()))
        if block.size >= BLOCK_TOKENS:
            yield block.postings()
            n += 1
            block = Block(v, backoff.value, slots, values, buckets, n)
    if block.docs:
        yield block.postings()


def decide(row: dict, table: tuple[np.ndarray, np.ndarray], vocab: Vocabulary, backoff: Backoff,
           alphas: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[bytes, bytes, bytes]:
    """What one block's postings of a bucket add: documents, known tokens, sums; words of the open model add to both scores.

    The open model's table of bigrams has gains, and ``alphas`` are its bucket's histories.
    """
    keys, sizes, doc = unpack_sorted(row["keys"]), _from_planes(row["sizes"]), _from_planes(row["docs"])
    c = looked_up(keys, table)
    if row["kind"] == WORDS:
        values = [vocab.base(c)] + ([vocab.log_p(c) + looked_up(keys, alphas)] if alphas else [])
    else:
        values = [c if alphas else backoff.log_p(keys, c)]
    own, inverse = np.unique(doc, return_inverse=True)
    known = np.bincount(inverse, np.repeat((c > 0).astype(float), sizes), len(own)).astype(np.int64)
    return _planes(own), _planes(known), b"".join(np.bincount(inverse, np.repeat(x, sizes), len(own)).tobytes() for x in values)


DECIDED = "block long, kind int, docs binary, known binary, sums binary"


def decide_group(postings: pa.Table, tables: pa.Table, vocab, backoff) -> pa.Table:
    """What one bucket's postings add to the documents of each block, from that bucket of both tables."""
    got = {k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in (WORDS, PAIRS)}
    alphas = None
    if isinstance(vocab.value, Words):
        got[PAIRS] = alphas = np.zeros(0, np.uint64), np.zeros(0)
    for r in tables.to_pylist():
        if r["kind"] == PAIRS and alphas:
            got[PAIRS], alphas = backoff.value.bucket(r, vocab.value)
        else:
            got[r["kind"]] = unpack_sorted(r["keys"]), unpack(r["counts"], np.int64)
    out = [(r["block"], r["kind"], *((r["keys"], None, None) if r["kind"] == WHOLE else decide(r, got[r["kind"]], vocab.value, backoff.value, alphas)))
           for r in postings.to_pylist()]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in DECIDED.split(", ")])


def add_up(block: pa.Table) -> pa.Table:
    """The documents' rows of one block with all that buckets add to them."""
    parts = block.to_pylist()
    rows = pa.ipc.open_stream(next(r["docs"] for r in parts if r["kind"] == WHOLE)).read_all()
    sums = {n: rows.column(n).to_numpy().copy() for n in ROW_FIELDS[2:]}
    for r in parts:
        if r["kind"] != WHOLE:
            doc = _from_planes(r["docs"])
            value = np.frombuffer(r["sums"]).reshape(-1, len(doc))
            sums["base_score" if r["kind"] == WORDS else "score"][doc] += value[0]
            if len(value) > 1:
                sums["score"][doc] += value[1]
            if r["kind"] == WORDS:
                sums["n_known"][doc] += _from_planes(r["known"])
    return pa.table([rows.column("doc_id"), rows.column("n_tokens"), *[pa.array(x) for x in sums.values()]], ROW_FIELDS)


def score(docs: DataFrame, model: KatzModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)``, a row per input row.

    Defined cases: a null text counts as empty and has one token, the end. Null ids
    and repeated rows are scored each. Words are told apart by 64-bit hashes. Long
    texts are scored whole. With nothing to learn from, every word is unknown: the
    model gives each token probability 1, as the only unseen word. Other
    columns are ignored, an empty table gives no rows. ``docs`` must give its rows
    in the same order when a task is run again, as a scan of files does.
    """
    sc = docs.sparkSession.sparkContext
    vocab, backoff, hot = sc.broadcast(model.vocab), sc.broadcast(model.backoff), sc.broadcast(model.hot)
    buckets = model.buckets
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    postings = base.mapInArrow(giving_back(lambda it: read_texts(it, vocab, backoff, hot, buckets)), POSTINGS)
    tables = model.words.withColumn("kind", F.lit(WORDS)).unionByName(model.bigrams.withColumn("kind", F.lit(PAIRS)), allowMissingColumns=True)
    decided = postings.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(
        lambda a, b: decide_group(a, b, vocab, backoff), DECIDED)
    return decided.groupBy("block").applyInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 10) == 0
    model = fit(docs.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocab.total).cast("long").alias("train_tokens"),
                                     "base_score", "score")


ORACLE = None
