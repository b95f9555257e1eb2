import re

from helpers import by_id, docs

from sluice.llm import license_scan as S

SF = "/root/testdata/sf0.001"


def brute(text, threshold=0.9):
    """Every block of every template, without a filter."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in S.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    blocks = set()
    for label, t in S.TEMPLATES:
        want = re.findall(r"[a-z0-9]+", t.lower())
        size = 1 << max(3, (2 * len(want) - 1).bit_length())
        for a in range(0, len(words), size // 4):
            block = words[a:a + size]
            met = sum(min(want.count(w), block.count(w)) for w in set(want))
            if met >= threshold * len(want) - 1e-9:
                blocks.add((label, a, min(a + size, len(words)), met / len(want)))
    starts = [p for p, _ in places]
    own = {x for _, x in places}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | {b[0] for b in blocks})), 1.0 if places else max((b[3] for b in blocks), default=0.0), blocks)


def check(spark, pairs):
    got = by_id(S.license_scan(docs(spark, pairs).repartition(2)))
    assert sum(map(len, got.values())) == len(pairs)
    for i, t in pairs:
        assert any(tuple(r)[1:8] + ({tuple(b) for b in r.blocks},) == brute(t) for r in got[i])


def test_edges(spark):
    mit = S.TEMPLATES[3][1]
    check(spark, [(1, None), (2, ""), (3, "CC BY, cc-by cc  by"), (4, "ccby acc by cc byte É general Public LICENSE all rights reserved all rights reserved"),
                  (5, "x " * 9000 + mit + " y" * 9000), (6, mit.upper().replace("FREE", "")), (7, " ".join(mit.split()[::-1])), (None, "cc by"), (5, "cc by"),
                  (8, "licensed under cc by 4.0"), (9, "apache " * 5000), (10, "cc\x85by cc by")])


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = by_id(S.license_scan(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in rows:
        assert tuple(got[r.doc_id][0])[1:8] + ({tuple(b) for b in got[r.doc_id][0].blocks},) == brute(r.text)
    assert any(g[0].labels for g in got.values())


def test_empty_tables(spark):
    assert S.license_scan(docs(spark, [])).count() == 0
    assert S.license_scan(docs(spark, [(1, "mit license cc by")]), templates=()).collect()[0].labels == "cc-by"
