from helpers import by_id, docs

from sluice.llm.line_dedup import line_dedup

A, B = "a" * 40, "É" * 39 + "x"


def brute(pairs, min_docs=5):
    holders = {}
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.strip(strip).translate(low)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def check(spark, pairs, **kw):
    got = line_dedup(docs(spark, pairs).repartition(3), carry=["lang", "n"], **kw).collect()
    assert all((r.rest.lang, r.rest.n) == ("en", 7) for r in got)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got], key=repr) == brute(pairs)


def test_edges(spark):
    pairs = [(i, f" {A.upper()}\t\nown {i}\n{A}\n{B}\r") for i in range(6)]
    pairs += [(10, None), (11, ""), (12, A), (13, A[:-1]), (14, "\n".join([B] * 3000 + ["end"])), (None, A), (5, A), (20, B.replace("É", "é"))]
    check(spark, pairs)


def test_four_documents_are_too_few(spark):
    check(spark, [(i, A + "\n" + A) for i in (1, 2, 3, 4, 4, 4)])


def test_a_full_filter_stays_exact(spark):
    check(spark, [(i, "\n".join(f"{j:03}" + A for j in range(i, i + 300, 7))) for i in range(60)], filter_bits=6)


def test_empty(spark):
    assert line_dedup(docs(spark, [])).count() == 0
