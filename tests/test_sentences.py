"""Learned sentence ends: scores against plain counting, and F1 on held-out text against the rule."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import split_sentences
from sluice.operators import sentences as X

LANGS = {"en": (["dkz", "approx", "blv", "q.t", "mr"], ["then", "but"]), "fr": (["mgr", "env", "zq"], ["alors", "puis"])}


def corpus(seed, n):
    """(id, text, lang, sentences): invented sentences in which abbreviations stand before words and at ends."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        short, first = LANGS[lang]
        words = [f"{lang}{a}{b}o" for a in "bcdfgl" for b in "aeiou"]
        sentences = []
        for _ in range(rng.randint(2, 9)):
            s = [rng.choice(first) if rng.random() < 0.6 else rng.choice(words)] + rng.choices(words, k=rng.randint(2, 8))
            s[0] = s[0].capitalize()
            if rng.random() < 0.5:
                s.insert(rng.randint(1, len(s) - 1), rng.choice(short) + ".")
                if rng.random() < 0.5:
                    at = [j for j, w in enumerate(s) if w[:-1] in short][0] + 1
                    s[at] = s[at].capitalize()  # a name behind an abbreviation
            sentences.append(" ".join(s) + rng.choice("...!?"))
        out.append((i, rng.choice([" ", "\n", "  "]).join(sentences), lang, sentences))
    return out


def table(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "id long, text string, lang string")


def f1(found, gold):
    hit = sum((Counter(map(str.strip, f)) & Counter(g)).total() for f, g in zip(found, gold))
    return 2 * hit / (sum(map(len, found)) + sum(map(len, gold)))


def test_held_out_f1_is_above_the_rule(spark):
    model = X.fit_sentences(table(spark, corpus(1, 300)), "text", "lang")
    assert all(set(LANGS[g][0]) <= set(model.abbreviations[g]) for g in LANGS)
    held = corpus(2, 120)
    got = table(spark, held).select("id", X.split_learned("text", "lang", model).alias("a"), split_sentences("text", "lang").alias("b")).orderBy("id").collect()
    gold = [r[3] for r in held]
    learned, rule = f1([r.a for r in got], gold), f1([r.b for r in got], gold)
    assert learned > 0.97 and learned > rule + 0.1


def test_scores_equal_plain_counting(spark):
    rows = corpus(3, 60) + [(1000, None, "en", []), (1001, "", None, []), (1002, "“Quoted end.” (Then) a.b. x... 3.5. No. 7.", None, [])]
    stops, plain, total, n_stops = Counter(), Counter(), Counter(), Counter()
    for _, text, lang, _ in rows:
        for t in (text or "").split():
            t = re.sub(r"^[(“”\"']+|[)“”\"']+$", "", t)
            kind, lang_ = re.sub(r"[.!?,;:]+$", "", t).lower(), lang or "und"
            stop = bool(re.search(r"[^.]\.$", t))
            total[lang_] += 1
            n_stops[lang_] += stop
            if re.search(r"[^\W\d_]", kind):
                (stops if stop else plain)[lang_, kind] += 1
    got = {(r.lang, r.type): r for r in X.abbreviation_scores(X.corpus_tokens(table(spark, rows), "text", "lang")).collect()}
    assert set(got) == set(stops)
    for (g, w), r in got.items():
        a, b, p, size = stops[g, w], plain[g, w], n_stops[g] / total[g], len(w.replace(".", ""))
        want = 2 * (a * (math.log(0.99) - math.log(p)) + b * (math.log(0.01) - math.log(1 - p))) * math.exp(-size) * (len(w) - size + 1) * size ** -b
        assert (r.with_stop, r.without_stop) == (a, b) and r.score == pytest.approx(want)


def test_pieces_put_together_are_the_text(spark):
    texts = ["Hi Dr. No is here. \"Yes.\" He said... What?! Ok \x01\x02 a. b", None, "", "  \n ", "Mr. X. Then go. ", "dr. Then. then. end", "no mark", "a.b.c. D.\tE!"]
    model = X.SentenceModel({"en": ["dr", "mr"]}, {"en": ["then"]})
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", X.split_learned("t", F.lit("en"), model).alias("s")).orderBy("i").collect()]
    assert got[0] == ["Hi Dr. No is here.", '"Yes."', "He said...", "What?!", "Ok \x01\x02 a.", "b"]
    assert got[1:4] == [[], [], [""]] and got[4] == ["Mr. X.", "Then go."] and got[5] == ["dr.", "Then.", "then.", "end"]
    for t, s in zip(texts, got):
        assert "".join("".join(s).split()) == "".join((t or "").split())


def test_too_many_words_are_refused(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_WORDS", 1)
    with pytest.raises(ValueError):
        X.fit_sentences(table(spark, corpus(1, 60)), "text", "lang")


def test_tokens_are_counted_before_they_are_taken_apart(spark):
    one = X.corpus_tokens(table(spark, [(i, "He came. Then he went. Then", "en", []) for i in range(400)]), "text", "lang").collect()
    assert {(r.type, r.stop, r.after, r.before): r.k for r in one} == {
        ("he", False, "", None): 800, ("came", True, "", None): 400, ("then", False, ".", "came"): 400, ("went", True, "", None): 400, ("then", False, ".", "went"): 400}
