import hashlib
import re

import numpy as np
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.fill_in_middle import BORDERS, Borders, WaveletMatrix, arrange, class_pairs, fill_in_middle, restore

UNITS = {"word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


def brute(doc_id, text, unit="word", percent=50):
    text = text or ""
    units = UNITS[unit].findall(text)
    s = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, text, text, len(units), "plain", None, None
    if h[3] % 100 < 80:
        return doc_id, f"<S>{x}<P>{p}<M>{m}", text, len(units), "spm", len(p), len(m)
    return doc_id, f"<P>{p}<S>{x}<M>{m}", text, len(units), "psm", len(p), len(m)


EDGES = [None, "", " ", "a", " a", "a ", "\n\n\n", "a\n", "é\U0001F600 ü\x1f z\x0b\x0cq", "<P> x", "x <M", "<<S", "a <", "one two three four five six",
         "w " * 30_000, "\t".join("abcdef"), "no-break space stays one"]


@pytest.mark.parametrize("unit", sorted(BORDERS))
@pytest.mark.parametrize("percent", [50, 100])
def test_equals_a_plain_loop(spark, unit, percent):
    pairs = [(i, t) for i, t in enumerate(EDGES * 6)] + [(3, "again a b c")] * 3 + [(None, "null id here"), (None, None)]
    got = fill_in_middle(docs(spark, pairs).repartition(3), unit=unit, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(i, t, unit, percent) for i, t in pairs), key=repr)


def test_empty_table_and_unknown_unit(spark):
    assert fill_in_middle(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs(spark, []), unit="page")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=300))
def test_ranks(symbols):
    a = np.array(symbols, np.uint8)
    matrix, at = WaveletMatrix(a, 4), np.arange(len(a) + 1)
    for s in range(16):
        assert matrix.rank(s, at).tolist() == [int((a[:i] == s).sum()) for i in at]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t<PSM>é", max_size=40), max_size=6), st.sampled_from(sorted(BORDERS)))
def test_every_cut(texts, unit):
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    assert len(class_pairs(points, ends - sizes)) == len(points)
    b = Borders(points, ends - sizes, ends, unit)
    units = [UNITS[unit].findall(t) for t in texts]
    assert b.units().tolist() == [len(u) for u in units]
    for k in range(max(map(len, units), default=0) + 1):
        want = [len("".join(u[:k])) for u in units]
        assert b.cut(np.minimum(k, b.units())).tolist() == want


@given(st.text("<PSM> a"), st.text("<PSM> a"), st.text("<PSM> a"), st.sampled_from(["psm", "spm"]))
def test_restored_from_output_alone(p, m, s, form):
    if not any(x in p + m + s for x in ("<P>", "<S>", "<M>")):
        assert restore(arrange(p, m, s, form), form) == p + m + s
