import hashlib
import re

from helpers import by_id, docs

from sluice.llm.exact_dedup import exact_dedup


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = {}
    for norm, rows in groups.items():
        keep = sorted(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0][0]
        for i, _ in rows:
            out.setdefault(i, set()).add((keep, len(rows), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def check(spark, pairs, **kw):
    got = by_id(exact_dedup(docs(spark, pairs), digests=True, **kw))
    assert {k: {(r.keep_id, r.group_size, r.kept, r.text_sha256) for r in v} for k, v in got.items()} == brute(pairs)
    assert sum(map(len, got.values())) == len(pairs)


def test_edges(spark):
    long = "wörd " * 40000
    check(spark, [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, "ba"), (5, None), (6, ""), (7, " \x0b\x0c"), (8, "a\xa0b"),
                  (9, long), (10, long + "\n"), (11, long[:-2] + "x "), (12, "ab"), (None, "a  b "), (13, "😀é"), (14, "😀 é")])


def test_same_length_and_prefix(spark):
    check(spark, [(i, "p" * 300 + str(i % 3)) for i in range(9)], prefix_chars=4, bitmap_bits=6)


def test_repeated_rows_share_their_decision(spark):
    got = by_id(exact_dedup(docs(spark, [(1, "x"), (1, "x"), (2, "x ")])))
    assert [(r.keep_id, r.group_size, r.kept) for r in got[1]] == [(2, 3, False)] * 2


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
