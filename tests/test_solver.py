"""The gradient solver against numpy, its state, and its losses against the evaluation operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.operators import metrics as M
from sluice.operators import solver as S

DIM = 37


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        places = rng.integers(0, DIM, rng.integers(0, 12)).tolist()
        rows.append((places, [(m, float(rng.random() < 0.4), float(rng.choice([0.9, 1.0]))) for m in (1, 2) if m == 1 or i % 3]))
    df = spark.createDataFrame(rows, "places array<int>, members array<struct<model:int,y:double,w:double>>").repartition(5)
    return rows, df.cache()


def dense(rows, model):
    x, y, w = [], [], []
    for places, members in rows:
        for m, a, b in members:
            if m == model:
                x.append(np.r_[np.bincount(places, minlength=DIM) / np.sqrt(max(1, len(places))), 1.0])
                y.append(a)
                w.append(b)
    return np.array(x), np.array(y), np.array(w)


def plain_loss(name, x, y, w):
    b = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    if name == "focal":
        return 0.5 * (1 - np.exp(-b.mean())) ** 1.5 * b.mean()
    if name == "label_smoothing":
        lp = np.stack([-np.logaddexp(0, x), x - np.logaddexp(0, x)], 1)
        return (0.9 * -lp[np.arange(len(y)), y.astype(int)] - 0.1 * lp.mean(1)).mean()
    return (b * (w if name == "weighted_bce" else 1)).mean()


def plain_fit(name, rows, model, steps, lr=0.3, decay=0.001):
    """Adam on numeric gradients."""
    x, y, w = dense(rows, model)
    p, m, v, losses = np.zeros(DIM + 1), 0.0, 0.0, []
    keep = np.r_[np.ones(DIM), 0.0]
    for t in range(1, steps + 1):
        f = lambda q: plain_loss(name, x @ q, y, w)
        losses.append(f(p))
        g = np.array([(f(p + d) - f(p - d)) / 2e-5 for d in np.eye(DIM + 1) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - lr * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * keep * p)
    return p, losses


@pytest.mark.parametrize("name", sorted(S.LOSSES))
def test_equals_numpy(data, name):
    rows, df = data
    got = S.fit(df, S.State.new([1, 2], DIM), 4, name)
    for i, model in enumerate(got.models):
        p, losses = plain_fit(name, rows, model, 4)
        assert np.allclose([x[i] for x in got.losses], losses, atol=1e-6)
        # numeric gradients are exact to about 1e-9, and Adam's first steps divide by their size
        assert np.allclose(got.w[i], p, atol=1e-3) and np.corrcoef(got.w[i], p)[0, 1] > 1 - 1e-6


@pytest.mark.parametrize("name", sorted(S.LOSSES))
def test_gradient_to_1e6(data, name):
    rows, df = data
    state = S.State.new([1, 2], DIM)
    state.w = np.random.default_rng(1).normal(size=state.w.shape)
    value, grad = S.gradients(df, state, S.LOSSES[name])
    for i, model in enumerate(state.models):
        x, y, w = dense(rows, model)
        f = lambda q: plain_loss(name, x @ q, y, w)
        assert value[i] == pytest.approx(f(state.w[i]), abs=1e-9)
        assert np.allclose(grad[i], [(f(state.w[i] + d) - f(state.w[i] - d)) / 2e-5 for d in np.eye(DIM + 1) * 1e-5], atol=1e-6)


def test_a_loss_of_ones_own(data):
    square = S.Loss(lambda x, y, w: ((x - y) ** 2, 2 * (x - y)))
    one = data[1].select("places", F.filter("members", lambda m: m["model"] == 1).alias("members"))
    got = S.fit(one, S.State.new([1], DIM), 12, square, lr=0.1)
    assert got.losses[-1][0] < 0.6 * got.losses[0][0]


def test_going_on_from_a_saved_state(spark, data, tmp_path):
    whole = S.fit(data[1], S.State.new([1, 2], DIM), 5, "focal")
    part = S.fit(data[1], S.State.new([1, 2], DIM), 2, "focal")
    again = S.load_state(spark, S.save_state(spark, part, str(tmp_path / "state")))
    assert again.step == 2 and again.models == [1, 2]
    for a, b in ((again.w, part.w), (again.m, part.m), (again.v, part.v)):
        assert np.array_equal(a, b)
    done = S.fit(data[1], again, 3, "focal")
    assert done.step == 5 and np.allclose(done.w, whole.w, atol=1e-12)
    assert part.step == 2  # the given state stays as it is


def test_losses_agree_with_evaluation(spark, data):
    """What the solver minimises is what A6, A7 and A8 report."""
    state = S.State.new([1], DIM)
    state.w = np.random.default_rng(2).normal(size=state.w.shape)
    x, y, w = dense(data[0], 1)
    one = data[1].select("places", F.filter("members", lambda m: m["model"] == 1).alias("members"))
    logits = x @ state.w[0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(logits, y, w)], "x double, y double, w double")
    assert S.gradients(one, state, S.LOSSES["weighted_bce"])[0][0] == pytest.approx(M.weighted_bce(df, "x", "y", "w").first().loss)
    assert S.gradients(one, state, S.LOSSES["focal"])[0][0] == pytest.approx(M.focal_loss(df, "x", "y").first().loss)
    two = df.select(F.array(F.lit(0.0), "x").alias("l"), F.col("y").cast("int").alias("t"))
    assert S.gradients(one, state, S.LOSSES["label_smoothing"])[0][0] == pytest.approx(M.label_smoothing_loss(two, "l", "t").first()[0])


def test_a_model_without_rows_is_refused(data):
    with pytest.raises(ValueError):
        S.fit(data[1], S.State.new([1, 2, 3], DIM), 1)


def test_scores(spark, data):
    state = S.State.new([4], 1 << 10)
    state.w[:] = np.arange(state.w.shape[1])
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r for r in S.score(texts, state, ["id"], "t").collect()}
    places = {r.id: r.p for r in texts.select("id", S.token_places(F.coalesce("t", F.lit("none")), 1 << 10).alias("p")).collect()}
    for i, r in got.items():
        assert r.model == 4 and r.logit == pytest.approx(sum(places[i]) / np.sqrt(max(1, len(places[i]))) + (1 << 10))


def test_a_batch_of_many_places_is_looked_at_in_slices():
    rng, n = np.random.default_rng(6), 4000
    sizes = rng.integers(0, 900, n)
    places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(rng.integers(0, DIM, sizes.sum()).astype(np.int32)))
    y = rng.integers(0, 2, n).astype(float)
    entries = pa.StructArray.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(y), pa.array(np.ones(n))], ["model", "y", "w"])
    batch = pa.RecordBatch.from_arrays([places, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), entries)], ["places", "members"])
    w = rng.normal(size=(1, DIM + 1))
    tracemalloc.start()
    out = list(S.gradient_batches(iter([batch]), [1], w, S.LOSSES["bce"]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x, flat, row, scale = S.logits_of(places, w)
    value, slope = S.LOSSES["bce"].rows(x[:, 0], y, 1.0)
    sums = dict(zip(out.column("block").to_pylist(), out.column("sums").to_pylist(), strict=True))
    assert sums[-1] == pytest.approx([value.sum(), n])
    assert sums[0] == pytest.approx([*np.bincount(flat, weights=(slope * scale)[row], minlength=DIM), slope.sum()])
    assert peak < 25e6 < sizes.sum() * 8 * 2
