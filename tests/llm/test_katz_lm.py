import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs

from sluice.llm import katz_lm as K

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


class Brute:
    """The same model by dictionaries, evaluated recursively token by token."""

    def __init__(self, texts, size, closed=False):
        seqs = [tokens(t) for t in texts]
        self.c1 = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        h = {w: K.xxhash.xxh3_64_intdigest(w.encode()) for w in self.c1}
        self.vocab = set(sorted(self.c1, key=lambda w: (-self.c1[w], np.uint64(h[w]).view(np.int64)))[:size])
        n1, n2 = (sum(c == k for c in self.c1.values()) for k in (1, 2))
        self.g = max(1, n1)
        # the closed model's symbol stands for all other words, else each unseen word has an equal part
        self.unseen = 1 if closed else max(1, n1 * n1 / (2 * n2) if n2 else n1 * (n1 - 1) / 2)
        self.cv = Counter({w: c for w, c in self.c1.items() if w in self.vocab})
        self.cv[None] = self.n - sum(self.cv.values())
        self.c2 = Counter(b for s in seqs for b in self.pairs(s))
        of = Counter(self.c2.values())
        self.d = {c: 1.0 for c in range(1, 6)}
        if of[1] and 6 * of[6] / of[1] < 1:
            top = 6 * of[6] / of[1]
            for c in range(1, 6):
                if of[c] and 0 < (x := ((c + 1) * of[c + 1] / (c * of[c]) - top) / (1 - top)) <= 1:
                    self.d[c] = x
        self.after = defaultdict(dict)
        for (a, b), c in self.c2.items():
            self.after[a][b] = c

    def pairs(self, seq):
        ids = [w if w in self.vocab else None for w in seq]
        return list(zip(["start", *ids], ids))

    def p1(self, w):
        return (self.cv[w] + self.g * (w is None)) / (self.n + self.g) / (self.unseen if w is None else 1)

    def p(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        kept = sum(self.d.get(c, 1) * c for c in seen.values()) / total
        rest = 1 - sum(self.p1(x) for x in seen)
        scale = 1 / kept if rest < 1e-12 else total / (total + 1) if kept > 1 - 1e-12 else 1
        if w in seen:
            return scale * self.d.get(seen[w], 1) * seen[w] / total
        return (1 - scale * kept) / rest * self.p1(w)

    def row(self, text):
        seq = tokens(text)
        return (len(seq), sum(w in self.c1 for w in seq), sum(math.log10((self.c1[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in seq),
                sum(math.log10(self.p(a, b)) for a, b in self.pairs(seq)))


def texts(n, seed, size=300):
    rng = random.Random(seed)
    return [" ".join("W%d" % int(rng.paretovariate(0.7)) for _ in range(rng.randrange(size))) for _ in range(n)]


def same(spark, learn, pairs, vocabulary, hot, **kw):
    model = K.fit(docs(spark, list(enumerate(learn))).repartition(3), vocabulary=vocabulary, hot=hot, **kw)
    brute = Brute(learn, vocabulary, closed=True)
    got = sorted(([r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score, r.score] for r in K.score(docs(spark, pairs).repartition(2), model).collect()))
    want = sorted([i if i is not None else -1, *brute.row(t)] for i, t in pairs)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
    return model, brute


def test_against_brute_force(spark):
    learn = [*texts(60, 1), None, "", "A a\tA"]
    pairs = list(enumerate(texts(30, 2))) + [(100, None), (101, ""), (102, "é never É"), (None, "w1 w2"), (3, "w1 w2"), (103, "w1 " * 50000), (104, "start")]
    model, brute = same(spark, learn, pairs, 40, 30)
    for h in [*brute.vocab, None, "start", "unheard"]:
        assert sum(brute.p(h, w) for w in [*brute.vocab, None]) == pytest.approx(1)
    vocab, back = model.vocab, model.backoff
    assert back.p.sum() == pytest.approx(1)
    table = [(K.unpack_sorted(r.keys), K.unpack(r.counts, np.int64)) for r in model.bigrams.collect()]
    keys, n = (np.concatenate([t[i] for t in table]) for i in (0, 1))
    for h in range(vocab.size + 2):
        own = np.array([h << 32 | w for w in range(vocab.size + 1)], np.uint64)
        c = np.array([dict(zip(keys.tolist(), n.tolist(), strict=True)).get(k, 0) for k in own.tolist()])
        with np.errstate(divide="ignore"):
            assert (10 ** back.log_p(own, c)).sum() == pytest.approx(1)


def test_large_vocabulary_small_blocks(spark):
    old, K.BLOCK_TOKENS = K.BLOCK_TOKENS, 500
    try:
        same(spark, texts(40, 3), list(enumerate(texts(40, 4))), 100000, 0, buckets=7)
        same(spark, texts(40, 3), list(enumerate(texts(10, 4))), 3, 100000, buckets=2)
    finally:
        K.BLOCK_TOKENS = old


def test_nothing_to_learn(spark):
    same(spark, [], [(1, "a b"), (2, None)], 10, 10)
    model = K.fit(docs(spark, [(1, "a")]), vocabulary=10)
    assert K.score(docs(spark, []), model).count() == 0


def test_whole_table(spark):
    import zlib

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    brute = Brute([r.text for r in rows if not held[r.doc_id]], 1 << 16)
    got = {r.doc_id: r for r in K.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n, known, base, score = brute.row(r.text)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], n, known, brute.n)
        assert (g.base_score, g.score) == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_every_word_has_its_own_probability(spark):
    # few words are known to all tasks, the others have their own P(w) and histories all the same
    learn = [*texts(60, 5), None, "", "A a\tA"]
    pairs = [*enumerate(texts(30, 6)), (100, None), (101, "never w1 never"), (102, "w1 " * 50000), (103, "A a")]
    brute, old = Brute(learn, 1 << 30), K.BLOCK_TOKENS
    assert len(brute.c1) > 300
    want = {i: brute.row(t) for i, t in pairs}
    try:
        for frequent, hot, buckets, K.BLOCK_TOKENS in ((40, 30, 7, old), (0, 10, 2, 500), (3, 0, None, 500), (1 << 16, 1 << 18, 5, 500)):
            model = K.fit(docs(spark, list(enumerate(learn))).repartition(3), frequent=frequent, hot=hot, buckets=buckets)
            got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in K.score(docs(spark, pairs).repartition(2), model).collect()}
            assert got.keys() == want.keys()
            for i, w in want.items():
                assert got[i][:2] == w[:2] and got[i][2:] == pytest.approx(w[2:], rel=1e-9)
    finally:
        K.BLOCK_TOKENS = old
    for h in ["w1", "w2", "\n", "start", max(brute.c1)]:
        assert sum(brute.p(h, w) for w in brute.c1) + brute.unseen * brute.p(h, None) == pytest.approx(1)


def test_invented_words_score_below_known_ones(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = K.fit(docs_)
    rng = random.Random(7)
    real = next(t for (t,) in docs_.filter("length(text) > 2000").orderBy("doc_id").select("text").collect()).split()[:100]
    mixed = real[:]
    rng.shuffle(mixed)
    invented = ["zq" + "".join(rng.choices("bcdfghjkxyz", k=9)) for _ in range(100)]
    got = {r.doc_id: r.score / r.n_tokens for r in K.score(docs(spark, [(1, " ".join(real)), (2, " ".join(mixed)), (3, " ".join(invented))]), model).collect()}
    assert got[1] > got[2] > got[3]


def test_no_word_is_cut_from_the_default_model(spark):
    learn = [" ".join(f"t{i}" for i in range(70_000)), "t0 t1 t2"]
    model = K.fit(docs(spark, list(enumerate(learn))))
    brute = Brute(learn, 1 << 30)
    (r,) = K.score(docs(spark, [(1, "t3 t69999 t5 t68000 t68001 unheard")]), model).collect()
    assert r.score == pytest.approx(brute.row("t3 t69999 t5 t68000 t68001 unheard")[3], rel=1e-9)
    assert K.score(docs(spark, [(1, "a")]), K.fit(docs(spark, []))).collect()[0].score == 0


def test_words_are_looked_up_once_and_texts_read_in_slices(monkeypatch):
    import pyarrow as pa

    rows = [t if t is None else t.encode() for t in [*texts(40, 8), None, "", "A a\tA"]]
    asked, calls = [], []
    of = K.WordHashes.of

    def ids_of(h):
        asked.extend(h.tolist())
        return h

    def counted(self, part):
        calls.append(len(part))
        return of(self, part)

    hashes, ids, sizes = K.WordHashes(ids_of).of(rows)
    want = [[K.xxhash.xxh3_64_intdigest(w.encode()) for w in tokens(t and t.decode())] for t in rows]
    assert hashes.tolist() == ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert len(asked) == len(set(asked)) == len(set(sum(want, [])))
    monkeypatch.setattr(K.WordHashes, "of", counted)
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["text"])
    (out,) = K.count_words(iter([batch]), 1)
    table = dict(zip(K.unpack_sorted(out.column("keys")[0].as_py()).tolist(), K.unpack(out.column("counts")[0].as_py(), np.int64).tolist(), strict=True))
    assert calls == [len(rows)] and table == Counter(sum(want, []))


def test_slots_find_every_key_and_no_other():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        slots = K.Slots(keys)
        others = np.setdiff1d(rng.integers(0, 1 << 62, 3000).astype(np.uint64), keys)
        assert slots.places(keys).tolist() == list(range(len(keys))) and (slots.places(others) == -1).all()
    crowded = K.Slots(keys)
    crowded.slot = lambda k: np.zeros(len(k), np.int64)
    crowded.first[:], crowded.next[:] = -1, -1
    crowded.first[0], crowded.next[:-1] = 0, np.arange(1, len(keys))
    assert crowded.places(keys[:50]).tolist() == list(range(50)) and (crowded.places(others[:5]) == -1).all()
