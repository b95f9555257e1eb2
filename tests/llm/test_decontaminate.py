import random

import numpy as np
import pytest
from helpers import docs
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import decontaminate as D
from sluice.llm.common import byte_words, word_hashes

SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(400)]


def text(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "Q " + text(30, 1) + ". The answer is " + text(6, 2) + "."), (2, text(12, 3)), (3, None), (4, ""), (5, text(150, 5)), (6, "too short"),
            (7, text(50, 7)), (7, text(50, 7))]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string"), dict(rows)


def found(spark, bench, pairs):
    rows = D.decontaminate(docs(spark, pairs).repartition(3), bench[0]).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id) for r in rows}


def test_copies_paraphrases_and_clean_texts(spark, bench):
    items = bench[1]
    swapped = items[7].split()
    for k in range(2, 50, 7):
        swapped[k] = "other"
    pairs = [(i, text(300, 100 + i)) for i in range(60)]
    pairs += [(100, text(200, 20) + " " + items[1].upper() + " " + text(90, 21)), (101, text(40, 22) + "\n" + " ".join(swapped) + "! " + text(40, 23)),
              (102, items[2]), (103, text(60000, 24) + " " + items[7] + " " + text(3000, 25)), (104, text(500, 26) + " " + items[5] + text(10, 27)),
              (105, " ".join(items[1].split()[:12])), (106, None), (107, ""), (None, items[7]), (102, items[1]), (108, "too short")]
    assert found(spark, bench, pairs) == {(100, 1), (101, 7), (102, 2), (103, 7), (104, 5), (None, 7), (102, 1), (108, 6)}


def test_empty_tables(spark, bench):
    assert found(spark, bench, []) == set()
    assert D.decontaminate(docs(spark, [(1, "a")]), bench[0].filter("item_id < 0")).count() == 0


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert D.common_subsequence(D.Item.bits(a), len(a), b) == table[-1, -1]


def test_svd_of_passages(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 12)) * np.linspace(4, 0.5, 12)
    rows = [(list(range(12)), [float(x) for x in r]) for r in a]
    v, sigma = D.randomised_svd(spark.createDataFrame(rows, "terms array<int>, weights array<float>").repartition(3), 5)
    want = np.linalg.svd(a)
    assert np.allclose(sigma, want[1][:5], rtol=1e-3) and np.allclose(np.abs((v[:12] * want[2][:5].T).sum(0)), 1, atol=1e-2)


def test_word_hashes_tell_words_apart():
    texts = [b"The cat's 12", None, b"", b" ?! ", "É cat the-THE".encode(), b"x" * 300, b"word " * 5, b"ab ba"]
    h, sizes = word_hashes(texts)
    words = [w for t in texts for w in byte_words(t)]
    assert sizes.tolist() == [len(byte_words(t)) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist(), strict=True)))
    many = [b"%d" % i for i in range(200_000)]
    assert len(set(word_hashes([b" ".join(many)])[0].tolist())) == len(many)


def brute(texts, items):
    """Alignment of every item with every stretch of every text, without the search."""
    out = set()
    for d, t in texts:
        words = D.words_of((t or "").encode())
        sets = [(a, words[a:a + 160]) for a in range(0, max(1, len(words)), 40)]
        for it in items:
            for _, part in sets:
                if it.verified(part, 0.7, 0.5):
                    out.add((d, it.id))
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(table, bench).collect()}
    want = brute([(r.doc_id, r.text) for r in table.collect()], D.items_of([(r.item_id, r.text) for r in bench.collect()]))
    assert len(want) > 5 and got <= want and len(got & want) >= 0.97 * len(want)


def test_the_basis_is_fitted_on_all_passages(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS[:12], k=10)) for _ in range(2600)]
    vectors = D.latent_vectors(docs(spark, list(enumerate(texts))).selectExpr("doc_id", "cast(text as binary) AS text"),
                               spark.createDataFrame([], "item_id long, text binary"), 8)
    a = np.zeros((len(texts), D.TERMS), np.float32)
    for i, t in enumerate(texts):
        np.add.at(a[i], D.terms_of(np.array(D.words_of(t.encode()), np.uint64)), 1)
    idf = np.log((1 + len(a)) / (1 + (a > 0).sum(0))) + 0.1
    x = (a * idf / np.linalg.norm(a * idf, axis=1, keepdims=True)) @ (vectors / idf[:, None])
    assert np.allclose(x.T @ x, np.eye(8), atol=0.01)  # each direction has unit variance over the whole corpus
