"""Fitting linear models to any differentiable loss by distributed gradients (Q5, Q7 with A6, A7 or A8 as the criterion).

A row is a text's token places in a vector of ``dim`` weights (a hash of each
token) and its members: one entry per model that it trains, with label and
weight. So a text that several epochs draw is hashed and read once, and one job
per step gives the gradients of all models:

* every task adds up its rows' gradients in Arrow batches, one bounded vector per
  model, and gives them out in blocks;
* blocks are summed by an aggregate (map-side first), and only the sums, whose
  size is models x ``dim``, reach the driver;
* the driver makes one step of Adam with decoupled weight decay (none on the
  intercept) and broadcasts the new weights.

The solver's whole state (weights, both moments, step) can be written as a table
and taken up again, by the same or another session and on other rows: k + m steps are the
same as k steps, saved, read, and m more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import u32
from sluice.functions.sequences import tokenize
from sluice.operators.metrics import FOCAL_ALPHA, FOCAL_GAMMA, SMOOTHING

BLOCK = 4096
#: Token places that a task looks at together; one text may have more.
PLACES = 1 << 18
#: Fixed values of Adam's moments.
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Loss:
    """A loss over logits x, labels y and weights w: ``outer(mean of rows)``.

    ``rows(x, y, w)`` gives each row's value and its derivative by x, ``outer(mean)``
    the loss and its derivative by the mean.
    """

    rows: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    outer: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = lambda mean: (mean, np.ones_like(mean))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def _bce(x, y, w):
    return np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))), _sigmoid(x) - y


def _weighted_bce(x, y, w):
    value, slope = _bce(x, y, w)
    return w * value, w * slope


def _focal(mean):
    """The factor depends on the mean over all rows, so it is applied to the summed gradient."""
    pt = np.exp(-mean)
    easy = np.maximum(1 - pt, 0)
    return (FOCAL_ALPHA * easy**FOCAL_GAMMA * mean,
            FOCAL_ALPHA * (easy**FOCAL_GAMMA + FOCAL_GAMMA * easy ** (FOCAL_GAMMA - 1) * pt * mean))


def _smoothed(x, y, w):
    """A8 with the two classes' logits (0, x)."""
    value, slope = _bce(x, y, w)
    both = _bce(x, 0.5, w)[0]
    return (1 - SMOOTHING) * value + SMOOTHING * both, (1 - SMOOTHING) * slope + SMOOTHING * (_sigmoid(x) - 0.5)


LOSSES = {"bce": Loss(_bce), "weighted_bce": Loss(_weighted_bce), "focal": Loss(_bce, _focal), "label_smoothing": Loss(_smoothed)}


@dataclass
class State:
    """What a solver knows: weights and moments of each model (rows; the last column is the intercept) and its steps."""

    models: list[int]
    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0
    losses: list[list[float]] = field(default_factory=list)

    @classmethod
    def new(cls, models: Sequence[int], dim: int) -> State:
        return cls(list(models), *(np.zeros((len(models), dim + 1)) for _ in range(3)))

    @property
    def dim(self) -> int:
        return self.w.shape[1] - 1

    def only(self, model: int) -> State:
        """The state of one model, to go on with alone."""
        i = self.models.index(model)
        return State([model], *(a[i:i + 1].copy() for a in (self.w, self.m, self.v)), self.step)


def token_places(text, dim: int) -> Column:
    """Place of each token in the weights, ``ARRAY<INT>``, repeated tokens repeated."""
    return F.transform(tokenize(text), lambda t: F.pmod(u32(t, "feature"), F.lit(dim)).cast("int"))


def training_rows(draws: DataFrame, texts: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """``(places, members)``, one row per text that ``draws`` (model, key, y, w) has; texts are hashed once."""
    members = draws.groupBy(key).agg(F.collect_list(F.struct(
        F.col("model").cast("int").alias("model"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))).alias("members"))
    return members.join(texts.select(key, text_col), key).select(token_places(text_col, dim).alias("places"), "members")


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, length of each)."""
    return col.flatten(), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose lists in the first column have at most PLACES values together, or a single row."""
    for batch in batches:
        ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PLACES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def logits_of(places: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logits [rows, models], flat places, row of each place, scale of each row): a text's tokens count 1 / sqrt(their number)."""
    flat, n = _lists(places)
    flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    scale = 1 / np.sqrt(np.maximum(n, 1))
    x = np.stack([np.bincount(row, weights=one[flat], minlength=len(n)) * scale + one[-1] for one in w], 1) if len(n) else np.zeros((0, len(w)))
    return x, flat, row, scale


def gradient_batches(batches: Iterator[pa.RecordBatch], models: list[int], w: np.ndarray, loss: Loss) -> Iterator[pa.RecordBatch]:
    """(model, block, sums): blocks of a task's summed gradients; block -1 has the sum of the losses and the number of rows."""
    grad, total = np.zeros_like(w), np.zeros((len(models), 2))
    number = {m: i for i, m in enumerate(models)}
    for batch in _slices(batches):
        x, flat, row, scale = logits_of(batch.column(0), w)
        entries, n = _lists(batch.column(1))
        of = np.repeat(np.arange(len(n)), n)
        model = np.array([number[m] for m in entries.field("model").to_pylist()], np.int64)
        y, weight = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        value, slope = loss.rows(x[of, model], y, weight)
        for i in range(len(models)):
            own = model == i
            by_row = np.bincount(of[own], weights=slope[own], minlength=len(n))
            grad[i, :-1] += np.bincount(flat, weights=(by_row * scale)[row], minlength=w.shape[1] - 1)
            grad[i, -1] += by_row.sum()
            total[i] += value[own].sum(), own.sum()
    for i, m in enumerate(models):
        blocks = [(-1, total[i])] + [(b, g) for b in range(0, w.shape[1], BLOCK) if (g := grad[i, b:b + BLOCK]).any()]
        ends = np.cumsum([0] + [len(g) for _, g in blocks]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"model": pa.array([m] * len(blocks), pa.int32()), "block": pa.array([b for b, _ in blocks], pa.int32()),
                                          "sums": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g for _, g in blocks])))})


def gradients(rows: DataFrame, state: State, loss: Loss) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each model, gradient of each model) at the state's weights: one job over the rows."""
    sc = rows.sparkSession.sparkContext
    sent, models = sc.broadcast(state.w), state.models
    parts = rows.mapInArrow(lambda it: gradient_batches(it, models, sent.value, loss), "model int, block int, sums array<double>")
    summed = parts.groupBy("model", "block").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).toArrow()
    sent.destroy()
    sums, grad = np.zeros((len(models), 2)), np.zeros_like(state.w)
    for m, block, s in zip(summed["model"].to_pylist(), summed["block"].to_pylist(), summed["sums"], strict=True):
        i, s = models.index(m), s.values.to_numpy()
        if block < 0:
            sums[i] = s
        else:
            grad[i, block:block + len(s)] = s
    if not sums[:, 1].all():
        raise ValueError("a model has no training rows")
    value, slope = loss.outer(sums[:, 0] / sums[:, 1])
    return value, grad / sums[:, 1:] * slope[:, None]


def fit(rows: DataFrame, state: State, steps: int, loss: str | Loss = "weighted_bce", lr: float = 0.3, decay: float = 0.001) -> State:
    """``steps`` more steps from ``state`` on ``rows`` (``training_rows``); the given state stays as it is.

    ``losses`` has, per step, each model's loss before the step. ``rows`` should be
    stored: every step reads it once.
    """
    loss = LOSSES[loss] if isinstance(loss, str) else loss
    now = State(state.models, state.w.copy(), state.m.copy(), state.v.copy(), state.step, list(state.losses))
    kept = np.r_[np.ones(now.dim), 0.0]
    for _ in range(steps):
        value, g = gradients(rows, now, loss)
        now.step += 1
        now.losses.append(value.tolist())
        now.m = BETA1 * now.m + (1 - BETA1) * g
        now.v = BETA2 * now.v + (1 - BETA2) * g * g
        m, v = now.m / (1 - BETA1**now.step), now.v / (1 - BETA2**now.step)
        now.w = now.w - lr * (m / (np.sqrt(v) + EPS) + decay * kept * now.w)
    return now


def save_state(spark: SparkSession, state: State, path: str) -> str:
    """The state as a Parquet table ``(model, step, place, w, m, v)`` of its non-zero places and every intercept."""
    used = state.w.astype(bool) | state.m.astype(bool) | state.v.astype(bool)
    used[:, -1] = True
    i, j = np.nonzero(used)
    table = pa.table({"model": pa.array(np.array(state.models, np.int32)[i]), "step": pa.array([state.step] * len(i), pa.int64()),
                      "dim": pa.array([state.dim] * len(i), pa.int64()), "place": pa.array(j),
                      "w": state.w[i, j], "m": state.m[i, j], "v": state.v[i, j]})
    spark.createDataFrame(table).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> State:
    """What ``save_state`` wrote; its size is models x places."""
    t = spark.read.parquet(path).toArrow()
    cols = {c: t.column(c).to_numpy() for c in t.column_names}
    models = sorted(set(cols["model"].tolist()))
    state = State.new(models, int(cols["dim"][0]))
    at = np.searchsorted(models, cols["model"]), cols["place"]
    for a, c in ((state.w, "w"), (state.m, "m"), (state.v, "v")):
        a[at] = cols[c]
    state.step = int(cols["step"][0])
    return state


def score(texts: DataFrame, state: State, keep: Sequence[str], text_col: str) -> DataFrame:
    """``(model, *keep, logit, prob)``: every model's logit for every row, in Arrow batches; a missing text is the text 'none'."""
    rows = texts.select(token_places(F.coalesce(F.col(text_col), F.lit("none")), state.dim).alias("places"), *keep)
    sent, models = texts.sparkSession.sparkContext.broadcast(state.w), state.models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = logits_of(batch.column(0), sent.value)[0]
            for i, m in enumerate(models):
                yield pa.RecordBatch.from_pydict({"model": pa.array([m] * len(x), pa.int32())} | {c: batch.column(c) for c in keep}
                                                 | {"logit": pa.array(x[:, i], pa.float64())})

    schema = ", ".join(["model int", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "logit double"])
    return rows.mapInArrow(run, schema).withColumn("prob", 1 / (1 + F.exp(-F.col("logit"))))
