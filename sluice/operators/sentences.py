"""X7 with learned sentence ends: which words are abbreviations and which begin sentences, from counts over the corpus.

Per language, by log-likelihood ratios (Kiss and Strunk, 2006):

* a word is an abbreviation if it nearly always carries a full stop, more so if it is
  short or has inner stops, less so the more often it stands without one;
* a word begins sentences if it follows a sentence end far more often than chance has it.

Both are aggregates over (language, word) with partial sums in the tasks. A
sentence then ends at ``!``, ``?`` or at the full stop of a word that is no
abbreviation, and behind an abbreviation only where a word that begins sentences follows
with a capital letter. Splitting is a built-in expression over the pieces of a text; nothing
is marked in the text, so every character may occur in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import NON_WS, WS, U
from sluice.session import materialize

#: Fixed values of the method: assumed share of stops behind an abbreviation, thresholds of the two scores.
STOP_SHARE = 0.99
LEAST_ABBREVIATION = 0.3
LEAST_STARTER = 30.0
#: More learned words than this do not go into an expression.
MOST_WORDS = 100_000

OPENING, CLOSING = r"[\p{Ps}\p{Pi}\p{Pf}\"'¿¡]", r"[\p{Pe}\p{Pi}\p{Pf}\"']"


def corpus_tokens(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, type, stop, after, before, k)``: equal tokens with their number. ``type`` is the lower-cased word, null without a letter;
    ``after`` is the mark (``.``, ``!``, ``?``) that the token before ends with, else ''; ``stop``: the token ends with a full stop;
    ``before``: the lower-cased word before, if that ends with one.

    Tokens are counted as they stand before any is taken apart, so the patterns run once for each different pair of a token
    and a marked one before it. The counts are stored: both scores read them.
    """
    token = F.regexp_replace(F.col("t"), U + f"^{OPENING}+|{CLOSING}+$", "")
    before = F.regexp_replace(F.col("p"), U + f"{CLOSING}+$", "")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), U + WS + "+"), lambda t: t != "")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), words.alias("_w"))
    pairs = F.zip_with("_w", F.concat(F.array(F.lit("")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0)))), lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    x = rows.select("lang", F.explode(pairs).alias("x"))
    marked = F.col("x.p").contains(".") | F.col("x.p").contains("!") | F.col("x.p").contains("?")
    x = x.select("lang", "x.t", F.when(marked, F.col("x.p")).otherwise("").alias("p")).groupBy("lang", "t", "p").agg(F.count(F.lit(1)).alias("k"))
    kind = F.lower(F.regexp_replace(token, r"[.!?,;:]+$", ""))
    found = x.select("lang", F.when(kind.rlike(r"\p{L}"), kind).alias("type"), token.rlike(r"[^.]\.$").alias("stop"),
                     F.regexp_extract(before, r"([.!?])$", 1).alias("after"),
                     F.when(before.rlike(r"[^.]\.$"), F.lower(F.regexp_replace(F.regexp_replace(before, U + f"^{OPENING}+", ""), r"\.$", ""))).alias("before"), "k")
    return materialize(found.groupBy("lang", "type", "stop", "after", "before").agg(F.sum("k").alias("k")))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def abbreviation_scores(tokens: DataFrame) -> DataFrame:
    """``(lang, type, with_stop, without_stop, score)`` of every word that carries a full stop somewhere."""
    counts = tokens.groupBy("lang", "type").agg(F.sum(F.when(F.col("stop"), F.col("k")).otherwise(0)).alias("with_stop"),
                                                F.sum(F.when(~F.col("stop"), F.col("k")).otherwise(0)).alias("without_stop"))
    counts = materialize(counts)
    total = counts.groupBy("lang").agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("n"))
    c = counts.filter(F.col("type").isNotNull() & (F.col("with_stop") > 0)).join(total, "lang")
    a, p = F.col("with_stop"), F.col("stops") / F.col("n")
    ratio = 2 * (a * (F.log(F.lit(STOP_SHARE)) - _log(p)) + F.col("without_stop") * (F.log(F.lit(1 - STOP_SHARE)) - _log(1 - p)))
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inner = F.length("type") - letters + 1
    score = ratio * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -F.col("without_stop").cast("double"))
    return c.select("lang", "type", "with_stop", "without_stop", score.alias("score"))


def starter_scores(tokens: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``(lang, type, starts, n, score)`` of every word that stands behind a sentence end."""
    known = abbreviations.select("lang", F.col("type").alias("before"), F.lit(True).alias("short"))
    t = tokens.groupBy("lang", "type", "before", "after").agg(F.sum("k").alias("k")).join(known, ["lang", "before"], "left")
    starts = F.sum(F.when((F.col("after") != "") & F.col("short").isNull(), F.col("k")).otherwise(0))
    c = materialize(t.groupBy("lang", "type").agg(starts.alias("starts"), F.sum("k").alias("n")))
    total = c.groupBy("lang").agg(F.sum("starts").alias("ends"), F.sum("n").alias("all"))
    c = c.filter(F.col("type").isNotNull() & (F.col("starts") > 0)).join(total, "lang")
    ab, b, a, n = F.col("starts"), F.col("n"), F.col("ends"), F.col("all")

    def two(k, m, q):
        return k * _log(q) + (m - k) * _log(1 - q)

    rest = F.greatest(n - a, F.lit(1))
    score = 2 * (two(ab, a, ab / a) + two(b - ab, n - a, (b - ab) / rest) - two(ab, a, b / n) - two(b - ab, n - a, b / n))
    return c.select("lang", "type", "starts", "n", F.when(ab / a > b / n, score).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class SentenceModel:
    """The learned words by language."""

    abbreviations: dict[str, list[str]]
    starters: dict[str, list[str]]


def fit_sentences(docs: DataFrame, text_col: str, lang_col: str) -> SentenceModel:
    """The words whose scores reach the thresholds; more than ``MOST_WORDS`` are refused."""
    tokens = corpus_tokens(docs, text_col, lang_col)
    short = materialize(abbreviation_scores(tokens).filter(F.col("score") >= LEAST_ABBREVIATION).select("lang", "type"))
    first = starter_scores(tokens, short).filter(F.col("score") >= LEAST_STARTER).select("lang", "type")
    out = []
    for table in (short, first):
        rows = table.limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words were learned; raise the thresholds")
        words: dict[str, list[str]] = {}
        for r in sorted(rows):
            words.setdefault(r.lang, []).append(r.type)
        out.append(words)
    return SentenceModel(*out)


def _among(word: Column, lang: Column, words: dict[str, list[str]]) -> Column:
    """Whether ``word`` is one of its language's words (a set in the plan, as ``isin`` makes it)."""
    hit = F.lit(False)
    for code, own in sorted(words.items()):
        hit = hit | ((lang == code) & word.isin(own))
    return hit


def split_learned(col, lang, model: SentenceModel) -> Column:
    """The sentences of a text as ``ARRAY<STRING>``, without the white space between them.

    A null or empty text has none, one of white space alone an empty one. ``lang`` is a column of language codes; a language the model does not know has no abbreviations.
    """
    text, code = (F.col(c) if isinstance(c, str) else c for c in (col, lang))
    code = F.coalesce(code, F.lit("und"))

    def ends(pieces: Column, piece: Column, i: Column) -> Column:
        # the word begins behind white space, so no search starts inside a word
        word = F.lower(F.regexp_replace(F.regexp_extract(piece, U + f"(?<!{NON_WS})({NON_WS}*[^.{WS[1:-1]}])\\.{CLOSING}*{WS}+$", 1), U + f"^{OPENING}+", ""))
        following = F.regexp_extract(F.try_element_at(pieces, (i + 2).cast("int")), U + f"^{OPENING}*({NON_WS}+)", 1)

        def first(w: Column) -> Column:
            return F.lower(F.regexp_replace(w, U + f"[.!?,;:]*{CLOSING}*[.!?,;:]*$", ""))

        short = _let(word, lambda w: (w != "") & _among(w, code, model.abbreviations))
        begins = _let(following, lambda w: w.rlike(r"^\p{Lu}") & _let(first(w), lambda f: _among(f, code, model.starters)))
        return (i == F.size(pieces) - 1) | ~short | F.coalesce(begins, F.lit(False))

    def joined(pieces: Column, last: Column) -> Column:
        begin = F.slice(F.concat(F.array(F.lit(0)), last), 1, F.size(last))
        return F.zip_with(last, begin, lambda b, a: F.regexp_replace(F.array_join(F.slice(pieces, a + 1, b - a), ""), U + WS + "+$", ""))

    def sentences(pieces: Column) -> Column:
        at = F.transform(pieces, lambda piece, i: F.when(ends(pieces, piece, i), i + 1))
        return _let(F.filter(at, lambda i: i.isNotNull()), lambda last: joined(pieces, last))

    # pieces end behind a mark and its white space
    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(U + f"(?s).*?[.!?]{CLOSING}*{WS}+|.+$"), F.lit(0)), sentences)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (an expression inside a lambda would be computed for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)
