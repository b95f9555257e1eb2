import numpy as np
import pytest
from helpers import docs

from sluice.llm.substring_dedup import lengths, substring_dedup


def brute(pairs, target):
    def rank(i):
        return (i is not None, i or 0)
    words = [[w.decode() for w in (t or "").encode().split()] for _, t in pairs]
    first = {}
    for (i, _), ws in zip(pairs, words):
        for j in range(len(ws) - target + 1):
            k = tuple(ws[j:j + target])
            first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for (i, _), ws in zip(pairs, words):
        gone = set()
        for j in range(len(ws) - target + 1):
            if first[tuple(ws[j:j + target])] < rank(i):
                gone |= set(range(j, j + target))
        out.append((i, " ".join(w for j, w in enumerate(ws) if j not in gone), len(ws), len(gone),
                    sum(b - a for a, b in zip(sorted(gone), sorted(gone)[1:]) if b - a > 1) >= 0))
    return sorted(out, key=repr)


def check(spark, pairs, target=50, **kw):
    got = substring_dedup(docs(spark, pairs).repartition(3), target=target, carry=["lang", "n"], **kw).collect()
    assert all((r.rest.lang, r.rest.n) == ("en", 7) for r in got)
    for r in got:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed
    assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed, True) for r in got], key=repr) == brute(pairs, target)


def passage(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_lengths():
    assert lengths(50, 25) == [25, 50] and lengths(50, 6) == [4, 7, 13, 25, 50] and lengths(1, 1) == [1]
    assert all(b <= 2 * a for n in range(1, 70) for least in (1, 5) for a, b in zip(lengths(n, least), lengths(n, least)[1:]))


def test_passages(spark):
    p, q = passage(1, 50), passage(2, 120)
    pairs = [(1, f"{passage(3, 10)} {p}\n\n{passage(4, 10)}"), (2, p), (3, p.rsplit(" ", 1)[0]), (4, f"x {p} y {q} z"), (5, q), (6, q.upper()),
             (7, f"{q} {q}"), (8, None), (9, ""), (10, " \n\t "), (None, f"a {q} b"), (None, q), (5, f"own {q} words"), (5, q),
             (11, "la " * 5000), (12, "la " * 70), (0, "la " * 49), (13, p.replace(" ", " ")), (14, p.replace(" ", "\x0b"))]
    check(spark, pairs)
    check(spark, pairs, least=3)


@pytest.mark.parametrize("target", [1, 2, 3, 7])
def test_short_windows(spark, target):
    rng = np.random.default_rng(target)
    pairs = [(int(i), " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))) for i in range(40)]
    check(spark, pairs, target=target, least=1)
    check(spark, pairs, target=target, least=2)


def test_a_passage_of_very_many_documents(spark):
    # with at_least=1000 rows per key the passage's windows are too frequent for the shuffle join
    p = passage(9, 52)
    pairs = [(i, f"{i} {p} {i + 1}") for i in range(1500)] + [(5000 + i, passage(100 + i, 60)) for i in range(20)]
    check(spark, pairs)


def test_nothing_repeats_and_empty(spark):
    check(spark, [(i, passage(i, 80)) for i in range(5)])
    assert substring_dedup(docs(spark, [])).count() == 0
