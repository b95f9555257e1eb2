"""Source divergence audit: how far the word use of each source lies from that of every other, with count-level bitmaps.

A term's share in a group depends on its count there alone, so a comparison of
two groups needs only how many terms have count c in one and d in the other.

1. One scan counts terms by (lang, source), in the tasks first. Terms in enough documents of a
   language are kept, dealt to blocks of about ``block`` terms by a hash, and
   numbered in a block in the order of their bytes.
2. The bitmaps of a block: for each group and count the set of its term numbers, as
   64-bit words, only those that hold something.
3. Per block, and per pair of stripes of sources where a language has many, the
   words of all groups meet: AND and popcount give each pair's joint cells, and the
   complement of a group's union gives its terms of count 0. A cell's terms all have the
   same divergence f, so its size is multiplied by f. Sums over blocks are the
   pairs' values. The cells against the whole language are also kept as sets: a
   block's terms of largest f, ties in number order, are the candidates of the report by term.

All numbers are integers; shares are billionths, by long division.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import read_table, row_slices, stored

KEY = "op12_source_divergence"

SCALE = 1_000_000_000
SLICE_BYTES = 2_000_000
#: Distinct terms, and counts by group and term, that a task holds before it gives them out.
HELD_TERMS, HELD_ROWS = 400_000, 2_000_000
OUT_ROWS = 50_000
CELLS = 1 << 21

#: Byte table: A-Z to lower case, every other ASCII byte that is no letter to a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Held:
    """What a task has counted so far: per (lang, source) and term its occurrences and its documents."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.terms: dict[bytes, int] = defaultdict(count().__next__)  # numbered as they come
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, groups: list[tuple], texts: list[bytes]) -> None:
        rows = [t.translate(TERM_BYTES).split() for t in texts]
        own = [self.groups.setdefault(g, len(self.groups)) for g in groups]
        n = np.array([len(r) for r in rows], np.int64)
        term = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(rows)), np.int64, int(n.sum()))
        # once per document, then once per group
        key, times = np.unique(np.repeat(np.arange(len(rows)), n) << 32 | term, return_counts=True)
        key = np.array(own, np.int64)[key >> 32] << 32 | key & 0xFFFFFFFF
        self.parts.append(_summed(key, times, np.ones_like(times)))
        self.size += len(self.parts[-1][0])

    def given(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs); the empty term stands for the group itself."""
        langs, sources = (pa.array([g[i] for g in self.groups] or [""], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_pydict({
            "lang": langs, "source": sources, "term": pa.array([b""] * len(langs), pa.binary()),
            "n": pa.array([0] * len(langs), pa.int64()), "docs": pa.array([0] * len(langs), pa.int64())}).slice(0, len(self.groups))
        if self.parts:
            key, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            terms, group = pa.array(list(self.terms), pa.binary()), pa.array(key >> 32)
            for i in range(0, len(key), OUT_ROWS):
                at = slice(i, i + OUT_ROWS)
                part = group[i:i + OUT_ROWS]
                yield pa.RecordBatch.from_pydict({
                    "lang": langs.take(part), "source": sources.take(part), "term": terms.take(pa.array(key[at] & 0xFFFFFFFF)),
                    "n": pa.array(n[at]), "docs": pa.array(docs[at])})


def _summed(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, n, docs
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, summed over as many rows as memory allows."""
    held = Held()
    for batch in batches:
        for part in row_slices(batch, 2, SLICE_BYTES):
            held.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), part.column(2).to_pylist())
            if len(held.terms) >= HELD_TERMS or held.size >= HELD_ROWS:
                yield from held.given()
                held = Held()
    yield from held.given()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), digit by digit in base 1000 so that nothing overflows."""
    out, rest = np.zeros_like(count), count.copy()
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Block:
    """The bitmaps of one block's groups (sources and the whole language): for each (group, count) the set of its term numbers."""

    def __init__(self, rows: pa.Table):
        heads = rows.filter(pc.is_null(rows.column("cnt")))
        vocab, self.size = heads.column("vocab")[0].as_py(), heads.column("terms")[0].as_py()
        self.names = [tuple(x) for x in zip(heads.column("whole").to_pylist(), heads.column("source").to_pylist(), strict=True)]
        self.stripe = np.array(heads.column("stripe").to_pylist(), np.int64)
        number = {k: i for i, k in enumerate(self.names)}
        total = np.array(heads.column("total").to_pylist(), np.int64) + vocab
        body = rows.filter(pc.is_valid(rows.column("cnt")))
        group = np.array([number[k] for k in zip(body.column("whole").to_pylist(), body.column("source").to_pylist(), strict=True)], np.int64)
        term, count = body.column("term_id").to_numpy().astype(np.int64), body.column("cnt").to_numpy()
        named = body.filter(body.column("whole"))
        self.terms = dict(zip(named.column("term_id").to_pylist(), named.column("term").to_pylist(), strict=True))
        n_words = (self.size + 63) // 64
        # rows of one (word, group, count) become one 64-bit word of that set
        order = np.lexsort((count, group, term >> 6))
        group, term, count = group[order], term[order], count[order]
        word = term >> 6
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (group[1:] != group[:-1]) | (count[1:] != count[:-1])][:len(word)])
        bits = np.uint64(1) << (term & 63).astype(np.uint64)
        bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        group, word, count = group[first], word[first], count[first]
        # the complement of all sets of a group: its terms of count 0
        union = np.zeros((len(self.names), n_words), np.uint64)
        np.bitwise_or.at(union, (group, word), bits)
        valid = np.full(n_words, ~np.uint64(0))
        if n_words and self.size % 64:
            valid[-1] = (np.uint64(1) << np.uint64(self.size % 64)) - np.uint64(1)
        zero = valid & ~union
        zg, zw = np.nonzero(zero)
        group, word, count = np.concatenate([group, zg]), np.concatenate([word, zw]), np.concatenate([count, np.zeros(len(zg), np.int64)])
        order = np.argsort(word, kind="stable")
        self.group, self.word, self.count = group[order], word[order], count[order]
        self.bits = np.concatenate([bits, zero[zg, zw]])[order]
        self.p = shares(self.count + 1, total[self.group])
        self.bounds = np.searchsorted(self.word, np.arange(n_words + 1))

    def cells(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, popcount) of the joint cells of rows in ``left`` and ``right`` (masks), word by word in bounded pieces."""
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            x, y = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(right[a:b])
            step = max(1, CELLS // max(1, len(y)))
            for s in range(0, len(x), step):
                n = np.bitwise_count(self.bits[x[s:s + step], None] & self.bits[y])
                i, j = np.nonzero(n)
                yield x[s:s + step][i], y[j], n[i, j].astype(np.int64)

    def pair_values(self, lane: tuple[int, int]) -> np.ndarray:
        """values[a, b]: the sum of f over the block's terms, group a against group b, of the lane's stripes."""
        n_groups = len(self.names)
        out = np.zeros(n_groups * n_groups, np.int64)
        source = np.array([not whole for whole, _ in self.names], bool)[self.group]
        left, right = (source & (self.stripe[self.group] == s) for s in lane)
        for i, j, n in self.cells(left, right):
            np.add.at(out, self.group[i] * n_groups + self.group[j], n * divergence(self.p[i], self.p[j]))
            if lane[0] != lane[1]:
                np.add.at(out, self.group[j] * n_groups + self.group[i], n * divergence(self.p[j], self.p[i]))
        return out.reshape(n_groups, n_groups)

    def top_terms(self, top: int, stripe: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, term numbers, f): each group's terms of larger share than in the language, the ``top`` of largest f."""
        whole = np.array([w for w, _ in self.names], bool)[self.group]
        parts: list[list[np.ndarray]] = [[], [], []]
        for i, j, _ in self.cells(~whole & (self.count > 0) & (self.stripe[self.group] == stripe), whole):
            keep = self.p[i] > self.p[j]
            i, j = i[keep], j[keep]
            parts[0].append(np.stack([i, j], 1))
            parts[1].append(divergence(self.p[i], self.p[j]))
            parts[2].append(self.bits[i] & self.bits[j])
        if not parts[0]:
            return
        rows, f, bits = (np.concatenate(p) for p in parts)
        set_bits = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, at = np.nonzero(set_bits)
        term, f, group = self.word[rows[cell, 0]] * 64 + at, f[cell], self.group[rows[cell, 0]]
        order = np.lexsort((term, -f, group))
        term, f, group = term[order], f[order], group[order]
        first = np.searchsorted(group, np.arange(len(self.names) + 1))
        for g, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                yield g, term[a:min(b, a + top)], f[a:min(b, a + top)]


OUT = "lang string, source string, part string, item string, value long"


def compare_block(rows: pa.Table, top: int) -> pa.Table:
    """The pair values of a block's lane, and of a diagonal lane also the candidate terms."""
    block = Block(rows)
    lane = rows.column("lane_a")[0].as_py(), rows.column("lane_b")[0].as_py()
    values = block.pair_values(lane)
    mine = [{i for i, (w, _) in enumerate(block.names) if not w and block.stripe[i] == s} for s in lane]
    pairs = sorted({(a, b) for a in mine[0] for b in mine[1] if a != b} | {(b, a) for a in mine[0] for b in mine[1] if a != b})
    source, item = [block.names[a][1] for a, _ in pairs], [block.names[b][1] for _, b in pairs]
    part, value = ["pair"] * len(pairs), [int(values[a, b]) for a, b in pairs]
    if lane[0] == lane[1]:
        for g, terms, f in block.top_terms(top, lane[0]):
            source += [block.names[g][1]] * len(terms)
            item += [block.terms[t] for t in terms.tolist()]
            part += ["term"] * len(terms)
            value += f.tolist()
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(part), pa.string()), "source": pa.array(source, pa.string()),
                     "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, group_col: str = "source", lang_col: str = "lang", text_col: str = "text", min_docs: int = 3,
                      top: int = 200, block: int = 4096, stripe: int = 64) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the divergence of each source from each other one of its language, and its terms.

    Terms are runs of letters (ASCII letters in lower case, and all code points
    above 127). A language keeps the terms of at least ``min_docs`` of its rows.
    With count c of a term in a group, N of all kept terms and V kept terms,
    p = 1 + floor(10^9 (c + 1) / (N + V)); f = floor((p - q)^2 / q). Part "pair":
    item is another source, value the sum of f over the kept terms. Part "term": item is a
    term of the source with p above the language's q, value its f, the ``top`` largest.
    ``block`` and ``stripe`` bound what a task holds and change no result.

    Defined cases: null texts, langs and sources count as ''. A group without terms
    and a language without kept terms are there too (all pair values are 0 without kept
    terms). Every row is a document, so a repeated row counts again. Equal values rank
    by the item's bytes. Long texts count whole. Other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (group_col, "source"))],
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    counts = stored(rows.mapInArrow(counts_of, "lang string, source string, term binary, n long, docs long")
                    .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "op12-counts")
    groups = counts.filter(F.length("term") == 0).select("lang", "source")
    # a term has one row per source of its language
    of_term = Window.partitionBy("lang", "term")
    own = stored(counts.filter(F.length("term") > 0)
                 .select("lang", "source", "term", F.col("n").alias("cnt"), F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("whole_n"),
                         F.min("source").over(of_term).alias("one"))
                 .filter(F.col("docs") >= min_docs).select("lang", "source", "term", "cnt", "whole_n", (F.col("source") == F.col("one")).alias("first")), "op12-own")
    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
             .join(own.groupBy("lang").agg(F.count_if("first").alias("vocab"), F.sum("cnt").alias("whole_total")), "lang", "left")
             .na.fill(0, ["vocab", "whole_total"])
             .withColumn("blocks", F.greatest(F.ceil(F.col("vocab") / block), F.lit(1)).cast("int"))
             .withColumn("stripes", F.ceil(F.col("sources") / stripe).cast("int")))
    langs = stored(langs, "op12-langs")
    numbered = stored(own.join(langs.select("lang", "blocks"), "lang")
                      .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
                      .withColumn("term_id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).drop("blocks"), "op12-numbered")
    # each group's row, and of a term's first row also one for the whole language, which has the term's name
    both = F.array(F.struct(F.lit(False).alias("whole"), "source", "cnt", F.lit(None).cast("string").alias("term")),
                   F.struct(F.lit(True).alias("whole"), F.lit("").alias("source"), F.col("whole_n").alias("cnt"), F.col("term").cast("string").alias("term")))
    body = numbered.select("lang", "block", "term_id", F.explode(F.slice(both, 1, F.when(F.col("first"), 2).otherwise(1))).alias("x")).select("lang", "block", "term_id", "x.*")
    # a row without a count for every group and block: its total, and the block's size
    totals = (groups.join(own.groupBy("lang", "source").agg(F.sum("cnt").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
              .withColumn("whole", F.lit(False))
              .unionByName(langs.select("lang", F.lit("").alias("source"), F.col("whole_total").alias("total"), F.lit(True).alias("whole"))))
    sizes = numbered.groupBy("lang", "block").agg(F.count_if("first").alias("terms"))
    heads = (totals.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .join(sizes, ["lang", "block"], "left").na.fill(0, ["terms"])
             .select("lang", "block", "whole", "source", "total", "terms", "vocab"))
    entries = heads.unionByName(body, allowMissingColumns=True).join(langs.select("lang", "stripes"), "lang")
    stripe_of = F.pmod(F.xxhash64("source"), F.col("stripes")).cast("int")
    entries = (entries.withColumn("stripe", F.when(~F.col("whole"), stripe_of).otherwise(-1))
               .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
               .withColumn("lane_a", F.when(F.col("whole"), F.col("lane")).otherwise(F.least("stripe", "lane")))
               .withColumn("lane_b", F.when(F.col("whole"), F.col("lane")).otherwise(F.greatest("stripe", "lane"))))
    found = stored(entries.groupBy("lang", "block", "lane_a", "lane_b").applyInArrow(lambda t: compare_block(t, top), OUT), "op12-found")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200
"""
