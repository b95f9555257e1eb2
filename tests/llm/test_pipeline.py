import random

import corpus_pipeline as P
from test_line_dedup import brute as brute_lines
from test_order_minhash import brute_groups

from sluice.llm import bpe
from sluice.llm.decontaminate import items_of, words_of

LANGS = {"en": "the and of with this that house mat were they on is", "fr": "le la les des une dans avec sur est chat maison enfants"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGS[lang].split()) + ("" if rng.random() < 0.5 else str(rng.randrange(1000))) for _ in range(n))


def test_against_brute_force(spark, tmp_path):
    items = [(i, text("en", 40, 900 + i) + ".") for i in range(5)]
    line = "This very line is repeated in so many of all the documents here."
    pairs = [(i, text("fr" if i % 3 else "en", 60 + i, i) + ("\n" + line if i % 4 == 0 else "")) for i in range(80)]
    pairs += [(200, pairs[7][1]), (201, pairs[9][1] + " end"), (300, text("en", 50, 400) + " " + items[2][1] + " " + text("en", 30, 401)),
              (400, None), (401, "123 !!"), (402, ""), (403, pairs[11][1].upper())]
    spark.createDataFrame([(i, t, None if t is None else "en" if i % 3 == 0 else "fr", None, 0, "a", None) for i, t in pairs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # brute force, stage by stage
    rows = [(i, t) for i, t in pairs if any(c.isalpha() for c in t or "")]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    group = brute_groups(rows)
    rows = [(i, t) for i, t in rows if group[i] == i]
    parts = items_of(items)
    rows = [(i, t) for i, t in rows if not any(p.verified(words_of(t.encode())[a:a + 100], 0.7, 0.5) for p in parts for a in range(0, 400, 10))]
    tok = bpe.load_tokenizer(bpe.word_bpe_source())
    want = {i: " ".join(map(str, tok.encode(t, add_special_tokens=False).ids)) for i, t in rows}
    assert {r.doc_id: r.id_text for r in P.run(spark, str(tmp_path)).collect()} == want
    assert {300, 400, 401, 402, 403, 200, 201}.isdisjoint(want) and len(want) > 70


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "the house " * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, text("en", 80, 1), "en", "s", None, "a", "b"), (2, None, None, None, None, None, None), (3, text("fr", 20000, 3), "fr", "s", 1, "a", "b")]
    for n in (0, 3):
        docs = spark.createDataFrame(rows[:n], DOCS)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), DOCS)
        assert sorted((str(r.doc_id), r.source, r.n_chars == len(r.text)) for r in docs.collect()) == ([] if n == 0 else [("3", "s", True), ("None", "s", True)])
        assert P.encode(spark, docs, str(tmp_path)).count() == (0 if n == 0 else 2)
