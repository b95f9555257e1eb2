import numpy as np
from helpers import by_id, docs

from sluice.llm import quality_cnn as Q

SF = "/root/testdata/sf0.01"


def test_chunks_hold_every_window_once():
    for size in (0, 1, Q.WIDTH - 1, Q.WIDTH, Q.CHUNK, Q.CHUNK + 1, 3 * Q.STEP + 7):
        text = np.random.default_rng(size).integers(1, 256, size).astype(np.uint8).tobytes()
        windows = [w.tobytes() for c in Q.chunk_bytes(text) for w in np.lib.stride_tricks.sliding_window_view(c, Q.WIDTH)]
        assert [w for w in windows if 0 not in w] == [text[i:i + Q.WIDTH] for i in range(size - Q.WIDTH + 1)]


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = Q.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks, first, y, w = rng.integers(0, 256, (5, Q.CHUNK)).astype(np.uint8), np.array([0, 2]), np.array([1.0, 0.0]), np.array([1.0, 3.0])
    net.pooled = lambda c: (net.responses(c).max(1), net.responses(c).argmax(1))

    def loss():
        z = net.head(net.responses(chunks).max(1), first)[0]
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()

    g = net.gradients(chunks, first, y, w)
    for k, x in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), x.shape)
        old = x[at]
        x[at] = old + 1e-5
        up = loss()
        x[at] = old - 1e-5
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_edges(spark):
    net = Q.Network()
    pairs = [(1, None), (2, ""), (None, "é"), (3, "word " * 100000), (3, "a"), (4, "\x00")]
    got = by_id(Q.quality(docs(spark, pairs), net))
    assert got[1][0].score == got[2][0].score and all(0 <= r.score <= 1 for v in got.values() for r in v)
    assert sum(map(len, got.values())) == len(pairs) and len(got[3]) == 2
    assert Q.quality(docs(spark, []), net).count() == 0


def test_no_labels(spark):
    empty = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, quality int")
    assert by_id(Q.quality(docs(spark, [(1, "x")]), Q.fit(empty)))[1][0].score == 0.5


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.query(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


def plain_score(net, text):
    """The score from the definition, a window and a filter at a time."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    hidden = []
    for a in range(0, max(1, len(text) - Q.WIDTH + 1), Q.STEP):
        chunk = text[a:a + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        best = [max(sum(p["tables"][j, chunk[i + j], f] for j in range(Q.WIDTH)) for i in range(Q.STEP)) for f in range(Q.FILTERS)]
        hidden.append(np.tanh(np.maximum(np.array(best) + p["bias"], 0) @ p["w1"] + p["b1"]))
    z = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)]) @ p["w2"] + p["b2"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_convolution(spark):
    rng = np.random.default_rng(3)
    net = Q.Network(5)
    texts = ["", "é", "a" * Q.CHUNK, *("".join(rng.choice(list("ab cdé\n"), n)) for n in (5, 511, 512, 513, 1500))]
    got = by_id(Q.quality(docs(spark, list(enumerate(texts))), net))
    for i, t in enumerate(texts):
        assert abs(got[i][0].score - plain_score(net, t.encode())) < 1e-5, i


def test_fit_reads_whole_texts(spark):
    # what tells the classes apart stands after 60,000 bytes of what both have
    filler = "one two three four " * 3200
    rows = [(i, filler + (" zqzq!" if i % 2 else " abab.") * 40, i % 2) for i in range(24)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = by_id(Q.quality(labelled, Q.fit(labelled, epochs=30)))
    assert min(got[i][0].score for i in range(1, 24, 2)) > max(got[i][0].score for i in range(0, 24, 2))


def test_fit_bounds_what_the_driver_holds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * 1000, i % 2) for i in range(20)] + [(7, "x" * 1000, 0)], "doc_id long, text string, quality int")
    taken = []
    monkeypatch.setattr(Q.Network, "fit", lambda self, texts, y, epochs: taken.append(len(texts)) or self)
    for max_bytes in (1, 1000, 3500, 1 << 20):
        Q.fit(rows, max_bytes=max_bytes)
    assert taken == [1, 1, 4, 21]
