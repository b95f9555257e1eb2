import random

import numpy as np
import pytest
from helpers import docs

from sluice.llm import order_minhash as M
from sluice.llm.common import byte_words
from sluice.llm.components import components

SF = "/root/testdata/sf0.001"
HASHES = M.WordHashes()


def seq(text):
    return M.shingles(np.array([HASHES[w] for w in byte_words((text or "").encode())], np.uint16))


def longest(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        t[i + 1, 1:] = np.where(b == x, t[i, :-1] + 1, t[i, 1:])
        t[i + 1] = np.maximum.accumulate(t[i + 1])
    return t[-1, -1]


def brute_groups(pairs, least=0.8):
    parts = [(i, seq(t)) for i, t in pairs]
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(parts):
        for j, b in parts[:k]:
            if len(a) == len(b) == 0 or (len(a) and len(b) and min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9
                                         and len(np.intersect1d(a, b)) >= least * (len(a) + len(b)) / (1 + least) - 1e-9
                                         and (n := longest(a, b)) / (len(a) + len(b) - n) >= least - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("zz%d" % rng.randrange(9**9) if rng.random() < share else w for w in text.split())


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(5000) for _ in range(n))


def groups(spark, pairs, **kw):
    rows = M.near_dedup(docs(spark, pairs).repartition(3), **kw).collect()
    assert len(rows) == len(pairs)
    sizes = {}
    for r in rows:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)
    return {r.doc_id: r.class_id for r in rows}


def test_edges(spark):
    a = words(200, 1)
    pairs = [(1, a), (2, a.upper().replace(" ", ", ")), (3, edited(a, 0.01, 2)), (4, " ".join(a.split()[::-1])), (5, None), (6, ""), (7, " ?! "),
             (8, "one two"), (9, "One, two!"), (10, "one"), (11, "x " * 30000), (12, "x " * 30001), (13, words(40000, 3)), (14, words(40000, 3) + " end"), (3, edited(a, 0.01, 2))]
    got = groups(spark, pairs)
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 10, 11: 11, 12: 11, 13: 13, 14: 13}


def test_null_ids(spark):
    rows = M.near_dedup(docs(spark, [(None, "a b c"), (None, "d e f g h i"), (4, "a b c")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in rows) == [
        ("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 1, True)]


def test_hub_with_many_copies_and_common_passage(spark):
    base, passage = words(300, 5), words(60, 6)
    pairs = [(i, edited(base, 0.012, 100 + i)) for i in range(1, 60)] + [(500, base)]
    pairs += [(1000 + i, words(20, 200 + i) + " " + passage + " " + words(40, 300 + i)) for i in range(40)]
    assert groups(spark, pairs) == brute_groups(pairs)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert groups(spark, rows) == brute_groups(rows)


def test_empty(spark):
    assert M.near_dedup(docs(spark, [])).count() == 0


def test_alignment_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = M.shingles(rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint16))
        b = M.shingles(rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint16))
        n = longest(a, b)
        want = n / (len(a) + len(b) - n)
        for least in (0.05, 0.3, 0.8):
            assert M.similarity_of(a, b, least) == pytest.approx(want if want >= least else 0.0)


def test_shared_bands_follow_similarity():
    a = words(400, 9)
    hit = [np.mean([(M.bands(seq(a)) == M.bands(seq(edited(a, e, s)))).any() for s in range(60)]) for e in (0.02, 0.3)]
    assert hit[0] == 1 and hit[1] < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(159, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 160), 200]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_later_links(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(0, i) for i in range(1, 40)]
    whole = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    known = None
    for a in range(0, len(edges), 100):
        known = components(spark.createDataFrame(edges[a:a + 100], "u long, v long"), known)
    rows = known.collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows) and got == {n: whole.get(n, n) for n in got}
    assert set(got) >= {x for e in edges if e[0] != e[1] for x in e}
    known = components(spark.createDataFrame([], "u long, v long"), known)
    assert {r.node: r.component for r in known.collect()} == got


def test_many_small_groups_that_share_most_of_their_text(spark):
    # all share a passage of 85 % of their words; two near copies of each, whose bands are nearly all the passage's
    passage = words(340, 20)
    pairs = []
    for g in range(40):
        own = words(60, 500 + g)
        pairs += [(10 * g + k, passage + " " + (own if k == 0 else edited(own, 0.2, 900 + g))) for k in range(2)]
    want = brute_groups(pairs)
    assert 20 <= len(set(want.values())) <= 60
    assert groups(spark, pairs, rounds=0) == want


def test_prefix_filter_is_exact(spark):
    rng = random.Random(4)
    passage = words(100, 30)
    pairs = [(10 * g + k, edited(passage + " " + words(rng.randrange(5, 30), 600 + g), rng.choice((0, 0.005, 0.02, 0.05)), 7 * g + k)) for g in range(25) for k in range(3)]
    nodes = spark.createDataFrame([(b"%d" % i, b"%d" % i, np.array([HASHES[w] for w in byte_words(t.encode())], np.uint16).tobytes()) for i, t in pairs],
                                  "node binary, component binary, words binary")
    got = {(bytes(r.u), bytes(r.v)) for r in M.prefix_pairs(nodes.select("node", "component"), nodes.select("node", "words"), 0.8).collect()}
    want = {tuple(sorted((b"%d" % i, b"%d" % j))) for k, (i, a) in enumerate(pairs) for j, b in pairs[:k] if M.similarity_of(seq(a), seq(b), 0.8) > 0}
    assert want and want <= got
