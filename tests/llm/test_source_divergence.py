import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm.source_divergence import SCALE, shares, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 1, 2) for i, t, g, s in rows], SCHEMA)


def brute(rows, min_docs=3, top=200):
    low = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    df, cnt, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, g, s in rows:
        g, s = g or "", s or ""
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
        groups[g].add(s)
        df[g].update(set(own))
        cnt[g, s].update(own)
    out = []
    for g, sources in groups.items():
        kept = [t for t, n in df[g].items() if n >= min_docs]

        def p_of(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + SCALE * (c[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: p_of(cnt[g, s]) for s in sources}
        q = p_of(sum((cnt[g, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if cnt[g, s][t] and p[s][t] > q[t])[:top]
            out += [(g, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found)]
    return sorted(out)


def rows_of(n=120, sources=9, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqré"] + ["Ünder", "ÉTÉ", "x1y", "it's"]
    weight = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(n):
        s = int(rng.integers(0, sources))
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=np.roll(weight, s) / weight.sum()))
        out.append((i, text, ["en", "fr", None][i % 3], f"src{s}" if s else None))
    return out


@pytest.mark.parametrize("how", [{}, {"block": 16}, {"block": 16, "stripe": 3}, {"stripe": 1, "top": 4}])
def test_equals_a_plain_loop(spark, how):
    rows = rows_of()
    got = source_divergence(table(spark, rows).repartition(4), **how).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=how.get("top", 200))


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 34", "en", "c"), (4, "only once", "de", "a"), (5, "only once", "de", "b"),
            (6, "Zed zed ZED " * 4000, "it", "a"), (7, "zed", "it", "a"), (7, "zed", "it", "a"), (8, "zed", "it", None), (None, "zed abc", "it", "b"),
            (9, "abc zed", "it", ""), (10, "abc é É", "it", "é"), (11, "é", "it", "z"), (12, "é", "it", "z"), (13, "lone", "pt", "a")]
    got = source_divergence(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert source_divergence(table(spark, [])).count() == 0


@given(st.integers(1, 9 * 10**14), st.data())
def test_shares_are_exact(total, data):
    count = data.draw(st.integers(0, total))  # no term has more than all
    assert shares(np.array([count]), np.array([total])).tolist() == [1 + SCALE * count // total]
