"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``CHUNK`` bytes that overlap by one byte
less than a filter's width, so every window of the whole text is seen exactly
once. Filters are learned tables, one weight per (offset, byte): a window's
response is a sum of table rows. Each filter's response is max-pooled over a
chunk; a hidden layer follows, and its mean and maximum over all chunks give
one logit.

Training takes a bounded sample of the labelled rows to the driver, where the
network is fitted: whole texts in the order of a hash of the id, at most
``max_rows`` of them, and none after the one that fills ``max_bytes``. Scoring is
one scan without a shuffle and reads every whole text, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import crc_mod, read_table, text_or_empty

KEY = "op7_quality_cnn"

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 16, 12, 512
STEP = CHUNK - (WIDTH - 1)


def n_chunks(size: int) -> int:
    return max(1, -(-(size - WIDTH + 1) // STEP))


def chunk_bytes(text: bytes) -> np.ndarray:
    """Chunks x CHUNK bytes, padded by zeros."""
    n = n_chunks(len(text))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1), writeable=False)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "w1": rng.normal(0, 0.3, (FILTERS, HIDDEN)),
                  "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, 2 * HIDDEN), "b2": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max over each chunk's windows of each filter's response, and where it is."""
        n = len(chunks)
        best, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
        for a in range(0, n, 32):  # a few chunks at a time stay in the processor's cache
            r = self.responses(chunks[a:a + 32])
            at[a:a + 32] = r.argmax(1)
            best[a:a + 32] = np.take_along_axis(r, at[a:a + 32, None, :], 1)[:, 0]
        return best, at

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        r = self.p["tables"][0][chunks[:, :STEP]]
        for j in range(1, WIDTH):
            r += np.take(self.p["tables"][j], chunks[:, j:j + STEP], axis=0)
        return r

    def best(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([self.responses(chunks[a:a + 16]).max(1) for a in range(0, len(chunks), 16)])

    def head(self, best: np.ndarray, first: np.ndarray):
        """Logit of each document, whose chunks begin at ``first``."""
        a = np.maximum(best + self.p["bias"], 0)
        h = np.tanh(a @ self.p["w1"] + self.p["b1"])
        n = np.diff(np.append(first, len(h)))[:, None]
        both = np.concatenate([np.add.reduceat(h, first, axis=0) / n, np.maximum.reduceat(h, first, axis=0)], 1)
        return both @ self.p["w2"] + self.p["b2"][0], (a, h, n, both)

    def score(self, text: bytes) -> float:
        chunks = chunk_bytes(text)
        # a piece of a long text at a time
        best = np.concatenate([self.best(chunks[a:a + 4096]) for a in range(0, len(chunks), 4096)])
        return float(_sigmoid(self.head(best, np.array([0]))[0].astype(np.float64))[0])

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray):
        best, at = self.pooled(chunks)
        z, (a, h, n, both) = self.head(best, first)
        dz = (_sigmoid(z) - y) * weight / weight.sum()
        doc = np.repeat(np.arange(len(first)), n[:, 0])
        dboth = dz[:, None] * self.p["w2"]
        dh = (dboth[:, :HIDDEN] / n)[doc]
        top = both[doc, HIDDEN:] == h  # ties share the gradient
        shared = np.add.reduceat(top.astype(np.float32), first, axis=0)[doc]
        dh = (dh + np.where(top, dboth[doc, HIDDEN:] / shared, 0)) * (1 - h * h)
        da = (dh @ self.p["w1"].T) * (a > 0)
        dt = np.zeros_like(self.p["tables"])
        rows = np.arange(len(chunks))[:, None]
        for j in range(WIDTH):
            np.add.at(dt[j], (chunks[rows, at + j], np.arange(FILTERS)[None, :]), da)
        return {"tables": dt, "bias": da.sum(0), "w1": a.T @ dh, "b1": dh.sum(0), "w2": both.T @ dz, "b2": dz.sum(keepdims=True)}

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam on the logistic loss; both classes weigh the same in a batch's loss at most 4:1."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        t, share = 0, np.clip([1 - y.mean(), y.mean()], 0.2, 0.8)
        steps = epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                sizes = [len(docs[i]) for i in pick]
                g = self.gradients(np.concatenate([docs[i] for i in pick]), np.cumsum([0, *sizes[:-1]]), y[pick], 1 / share[y[pick].astype(int)])
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        # scores follow the labels' share: undo the weights in the bias
        self.p["b2"] += np.float32(np.log(share[1] / share[0]))
        return self


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 2000,
        max_bytes: int = 1 << 27, epochs: int = 12) -> Network:
    """Network fitted to whole texts of at most ``max_rows`` rows with a label; without any, every score is 0.5.

    Rows are taken in the order of a hash of their id until the texts taken hold
    ``max_bytes`` or more, so that the driver holds no more than that and one text.
    """
    seen = rows.filter(F.col(label_col).isNotNull()).select(
        text_or_empty(text_col).cast("binary").alias("text"), (F.col(label_col) == 1).cast("double").alias("y"),
        F.xxhash64(F.col(id_col), F.lit("op7")).alias("h"), F.col(id_col).alias("i"))
    # at most max_rows rows are left for the running size
    before = F.sum(F.octet_length("text")).over(Window.orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1))
    top = seen.orderBy("h", "i").limit(max_rows).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_bytes)
    sample = top.select("text", "y").collect()
    net = Network()
    if not sample:
        net.p["w2"][:] = 0
        return net
    return net.fit([chunk_bytes(bytes(r.text)) for r in sample], np.array([r.y for r in sample], np.float32), epochs)


def score_batches(batches: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [net.value.score(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability of good quality, a row per input row.

    Defined cases: a null text counts as empty; an empty text is one chunk of
    zeros and has a score. Null ids and repeated rows are kept, texts are scored
    whole at any length. Other columns are ignored, an empty table gives no rows.
    """
    net_b = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return base.mapInArrow(lambda it: score_batches(it, net_b), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    labels = read_table(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality")
    # only the sample's texts are needed: the labels are cut to the sample before the join
    labels = labels.filter("quality is not null").orderBy(F.xxhash64("doc_id", F.lit("op7")), "doc_id").limit(2000)
    out = quality(docs, fit(docs.filter(~held).join(F.broadcast(labels), "doc_id")))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


ORACLE = None
