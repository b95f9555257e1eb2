"""Language ID: script ranges, per-word scores, Viterbi over spans.

1. Fit: every learning row adds its words' letter trigrams, hashed to a fixed
   number of buckets, and its letters' scripts to its language's counts. Counts
   are summed per task, then by Spark; the model has one row per language and
   bucket, whatever the input.
2. Score: a word's script leaves the languages that use it as candidates; a
   word's score under a language is its trigrams' log probability.
3. Label: Viterbi over a text's words, with a penalty for each switch, labels
   spans of mixed-language text. The texts of a slice advance together, word by
   word, as numpy arrays, sorted by length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import crc_mod, giving_back, read_table, row_slices, text_or_empty

KEY = "op8_language_id"

BUCKETS = 1 << 16
WORD = re.compile(r"[^\W\d_]+")
#: First code points of script blocks, in order; a block ends where the next begins.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80,
                          0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00,
                          0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0x10000, 0x20000])
#: The script of each block; blocks with an equal number are one script.
SCRIPT_OF = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 0,
                      1, 0, 27, 22, 22, 28, 29, 22, 28, 28, 0, 30, 28])
SCRIPTS = 31
SLICE_CHARS = 2_000_000
VITERBI_CELLS = 12_000_000
CACHE_WORDS = 150_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, the first trigram of each, and each word's script."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = flat[:-2] * np.uint64(0x9E3779B1) + flat[1:-1] * np.uint64(0x85EBCA77) + flat[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(15)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(n + 2)
    inside[ends[:-1] - 1] = False  # trigrams across two words
    inside[ends[:-1] - 2] = False
    starts = ends - (n + 2)
    script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, flat[starts + 1], "right") - 1]
    return (h[inside] % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]), script


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows; scripts are buckets above BUCKETS."""
    sums: dict[str, np.ndarray] = {}

    def add(lang: str, words: Counter) -> None:
        known = [w for w in words if has_letter(w)]
        if known:
            n = np.fromiter((words[w] for w in known), np.int64, len(known))
            grams, first, script = features(known)
            sizes = np.diff(np.append(first, len(grams)))
            total = sums.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
            total[:BUCKETS] += np.bincount(grams, np.repeat(n, sizes), BUCKETS).astype(np.int64)
            total[BUCKETS:] += np.bincount(script, n * sizes, SCRIPTS).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        words: dict[str, Counter] = {}
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
            size += len(text)
            if size >= SLICE_CHARS:
                for x in words.items():
                    add(*x)
                words, size = {}, 0
        for x in words.items():
            add(*x)
        if len(sums) > 100:
            yield from flush()
    yield from flush()


class Model:
    """Per language: log probabilities of buckets, and the scripts it uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5, script_share: float = 0.01):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS] + smoothing, counts[:, BUCKETS:]
        self.logp = np.ascontiguousarray(np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32))
        self.uses = scripts > script_share * np.maximum(scripts.sum(1, keepdims=True), 1)  # languages x scripts

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages, relative to a word's best; 0 where the word tells nothing."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = [i for i, w in enumerate(words) if has_letter(w)]
        if at:
            grams, first, script = features([words[i] for i in at])
            s = np.add.reduceat(self.logp[grams], first, axis=0)
            fits = self.uses.T[script]
            s[~fits & fits.any(1, keepdims=True)] = -1e4  # of the candidates that the script leaves
            s[~fits.any(1)] = 0
            out[at] = np.maximum(s - s.max(1, keepdims=True), -60)
        return out


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the rows with a language; None if there is none."""
    counted = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text")).mapInArrow(
        giving_back(count_features), "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS + SCRIPTS))
    counts[np.searchsorted(langs, summed["lang"]), summed["bucket"]] = summed["n"]
    return Model(langs, counts)


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best language of each word of each text; scores has words x languages per text."""
    sizes = np.array([len(s) for s in scores])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts longer than t
    stayed, came = np.ones(flat.shape, bool), np.zeros(len(flat), np.int16)
    v = flat[starts].copy()
    for t in range(1, sizes[0]):
        k = live[t]
        at = starts[:k] + t
        now = v[:k]
        top = now.argmax(1)
        least = now[np.arange(k), top] - switch
        stayed[at] = now >= least[:, None]
        came[at] = top
        np.maximum(now, least[:, None], out=now)
        now += flat[at]
    path = np.zeros(len(flat), np.int16)
    state = v.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        path[at] = state[:k]
        state[:k] = np.where(stayed[at, state[:k]], state[:k], came[at])
    out: list = [None] * len(scores)
    for j, i in enumerate(order):
        out[i] = path[starts[j]:starts[j] + sizes[j]]
    return out


class Labeller:
    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, len(self.model.langs)), np.float32)
        self.letters = np.zeros(CACHE_WORDS, np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        need = set().union(*texts)
        new = [w for w in need if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(need)
        if len(new) > len(self.rows):  # one slice alone has more words
            self.rows, self.letters = np.zeros((len(new), self.rows.shape[1]), np.float32), np.zeros(len(new), np.int64)
        first = len(self.cache)
        self.rows[first:first + len(new)] = self.model.scores(new)
        self.letters[first:first + len(new)] = [sum(map(str.isalpha, w)) for w in new]
        self.cache.update(zip(new, range(first, first + len(new)), strict=True))

    def spans(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(labels, letters, scores) of each text's words."""
        self.learn(texts)
        at = [np.fromiter(map(self.cache.__getitem__, t), np.int64, len(t)) for t in texts]
        scores = [self.rows[a] for a in at]
        full = [i for i, s in enumerate(scores) if len(s)]
        paths = dict(zip(full, viterbi([scores[i] for i in full], self.switch) if full else [], strict=True))
        for i, a in enumerate(at):
            yield paths.get(i, np.zeros(0, np.int16)), self.letters[a], scores[i]

    def decide(self, labels: np.ndarray, letters: np.ndarray, scores: np.ndarray) -> tuple[str, float, float, list[tuple[int, int, str]]]:
        """Language of most letters, its share times its certainty, the certainty of all spans, and the spans of words."""
        if not letters.sum():
            return "und", 0.0, 0.0, []
        share = np.bincount(labels, letters, len(self.model.langs))
        best = int(share.argmax())
        sure = {}
        for lang in np.flatnonzero(share).tolist():
            total = scores[labels == lang].sum(0, dtype=np.float64)
            sure[lang] = 1.0 / np.exp(np.clip(total - total[lang], -700, 50)).sum()
        certainty = sum(share[lang] * p for lang, p in sure.items()) / share.sum()
        edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        spans = [(int(a), int(b), self.model.langs[labels[a]]) for a, b in zip(edges, np.append(edges[1:], len(labels)), strict=True)]
        return self.model.langs[best], float(share[best] / share.sum() * sure[best]), float(certainty), spans


def label_batches(batches: Iterator[pa.RecordBatch], model, switch: float, with_spans: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    lab = None if model.value is None else Labeller(model.value, switch)
    most = SLICE_CHARS if lab is None else max(SLICE_CHARS // 4, min(SLICE_CHARS, VITERBI_CELLS * 5 // len(lab.model.langs)))
    for batch in batches:
        for part in row_slices(batch, 0, most):
            texts = [words_of(t) for t in part.column(0).to_pylist()]
            out = [("und", 0.0, 0.0, []) for _ in texts] if lab is None else [lab.decide(*x) for x in lab.spans(texts)]
            cols = {"lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64()),
                    "certainty": pa.array([x[2] for x in out], pa.float64())}
            if with_spans:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
                cols["spans"] = pa.array([[{"first": a, "last": b, "lang": x} for a, b, x in s] for _, _, _, s in out], kind)
            yield pa.RecordBatch.from_pydict(cols | {n: part.column(n) for n in part.schema.names[not with_text:]})


def language_id(docs: DataFrame, model: Model | None, text_col: str = "text", switch: float = 12.0,
                spans: bool = False, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``(lang_pred, score, certainty[, spans][, text], rest)``, a row per row of ``docs``; ``rest`` has its columns named in ``keep``.

    ``score`` is the share of the text's letters in spans of ``lang_pred``, times the
    probability of that language given those spans' words. ``certainty`` is that probability for the spans of
    each language, averaged over all letters: high too for a text of several languages. ``spans`` are half-open
    ranges of word numbers with their language.

    Defined cases: ``und`` with score and certainty 0 if the text is null or has no letter, or if
    nothing was learned. Of equal shares the first language by name wins. Null ids
    and repeated rows are kept; long texts are labelled whole; other columns are
    ignored, an empty table gives no rows. Words in a script that no language
    uses tell nothing.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(text_or_empty(text_col).alias("text"), F.struct(*[F.col(c) for c in keep]).alias("rest"))
    more = ", spans array<struct<first:bigint,last:bigint,lang:string>>" * spans + ", text string" * with_text
    return base.mapInArrow(giving_back(lambda it: label_batches(it, model_b, switch, spans, with_text)),
                           f"lang_pred string, score double, certainty double{more}, rest {base.schema['rest'].dataType.simpleString()}")


def fit_documents(docs: DataFrame) -> Model | None:
    """Learn from the rows whose crc32(doc_id) mod 3 is not 1."""
    return fit(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language_id(docs, fit_documents(docs))
    return out.select("rest.doc_id", (crc_mod(F.col("rest.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


ORACLE = None
