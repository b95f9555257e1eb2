import itertools

import numpy as np
import pytest
from helpers import docs

from sluice.llm import language_id as L

SF = "/root/testdata/sf0.01"
TEXTS = {"en": "the cat is on the mat and they were with this house ", "fr": "le chat est sur la table avec les enfants dans une maison ",
         "ru": "кошка сидит на столе и смотрит в окно дома "}


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(t * 5, k) for k, t in TEXTS.items()], "text string, lang string")
    return L.fit(rows)


def run(spark, model, texts, **kw):
    rows = L.language_id(docs(spark, list(enumerate(texts))), model, spans=True, **kw).collect()
    return [r for r in sorted(rows, key=lambda r: r.rest.doc_id)]


def test_edges(spark, model):
    got = run(spark, model, [None, "", "123 _ !?", "the house", "окно", "日本", "THE CAT le", "the cat is on " * 20000, "x" * 200000, "Ⅷ ²"])
    assert [(r.lang_pred, len(r.spans)) for r in got[:5]] == [("und", 0)] * 3 + [("en", 1), ("ru", 1)]
    assert got[7].lang_pred == "en" and got[7].score > 0.99 and got[9].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred in TEXTS for r in got[5:9])


def test_spans_of_mixed_text(spark, model):
    en, fr = TEXTS["en"].split(), TEXTS["fr"].split()
    (r,) = run(spark, model, [" ".join(en + fr)])
    assert [(s.first, s.last, s.lang) for s in r.spans] == [(0, len(en), "en"), (len(en), len(en) + len(fr), "fr")]
    assert 0.3 < r.score < 0.7


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 6, 4, 6, 2)]
    for s, got in zip(scores, L.viterbi(scores, 0.7), strict=True):
        def worth(p, s=s):
            return sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))
        assert worth(got) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(s)))), abs=1e-5)


def test_nothing_learned(spark):
    assert L.fit(spark.createDataFrame([("a", None)], "text string, lang string")) is None
    assert run(spark, None, ["the"])[0].lang_pred == "und"
    assert L.language_id(docs(spark, []), None).count() == 0


def test_held_out_accuracy(spark):
    got = L.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_certain_in_four_languages(spark):
    """A text evenly of four languages has a low share of each, and is certain all the same; the pipeline keeps it."""
    import random

    import corpus_pipeline as P

    words = {"en": "the house with garden and little window", "fr": "maison jardin avec petite fenêtre dans le", "de": "haus garten mit kleinem fenster und das", "es": "casa jardín con pequeña ventana y la"}
    rng = random.Random(3)
    say = lambda g, n: " ".join(rng.choices(words[g].split(), k=n))
    rows = [(i, say(g, 80), g, "s", 0) for i, g in enumerate(sorted(words) * 20)]
    rows += [(1000, " ".join(say(g, 60) for g in words), None, "s", 0), (1001, "... 12 34", None, "s", 0), (1002, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.identify_language(spark, docs, "").collect()}
    assert 1000 in kept and not {1001, 1002} & kept
