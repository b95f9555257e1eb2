"""Text scalar functions (X1-X8, X10, X12) as pure ``Column -> Column``.

All patterns run JVM-side inside whole-stage codegen; no Python UDF. Java's
regex engine is told ``(?U)`` so that ``\\s``, ``\\S`` and ``\\b`` follow Unicode
like the Python patterns whose behaviour we reproduce. Python's whitespace
also contains U+001C..U+001F, which Java's Unicode ``\\s`` does not, so the
whitespace class is spelled out as ``[\\s\\x1c-\\x1f]``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-compatible whitespace / non-whitespace classes for Java regex.
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"
U = "(?U)"

# Sentence boundary marker (never occurs in text we clean).
SENT_MARK = "\u0001"

# Language code -> language name used to pick sentence rules;
# unknown codes fall back to 'english'.
LANG_NAMES = {
    "en": "english",
    "it": "italian",
    "fr": "french",
    "es": "spanish",
    "tr": "turkish",
    "ru": "russian",
    "pt": "portuguese",
}
DEFAULT_LANG_NAME = "english"

# Abbreviations whose full stop does not end a sentence, by language name.
ABBREVIATIONS = {
    "english": ("mr", "mrs", "ms", "dr", "prof", "jr", "vs", "etc", "e.g", "i.e", "inc", "ltd", "approx"),
    "italian": ("sig", "dott", "prof", "ing", "avv", "ecc", "pag"),
    "french": ("m", "mme", "mlle", "dr", "cf", "p.ex", "env", "av"),
    "spanish": ("sr", "sra", "srta", "dr", "dra", "ud", "uds", "p.ej"),
    "turkish": ("dr", "prof", "vb", "vs", "sn", "örn"),
    "russian": ("г", "ул", "т.е", "т.д", "т.п", "др", "см"),
    "portuguese": ("sr", "sra", "dr", "dra", "prof", "ex", "pág"),
}
# Stands behind an abbreviation's full stop while sentences are split.
ABBR_MARK = "\u0002"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze_ws(col) -> Column:
    """Whitespace runs -> one space, no trim (``re.sub(r'\\s+', ' ', t)``)."""
    return F.regexp_replace(_c(col), U + WS + "+", " ")


def py_strip(col) -> Column:
    """``str.strip()``: drop leading/trailing Python whitespace."""
    return F.regexp_replace(_c(col), U + "^" + WS + "+|" + WS + "+$", "")


def squeeze_spaces(col) -> Column:
    """``' '.join(t.split())`` -- collapse and trim."""
    return F.trim(squeeze_ws(col))


def strip_numbers(col) -> Column:
    """Drop ASCII digits, then collapse whitespace (quotes stay)."""
    return squeeze_ws(F.regexp_replace(_c(col), "[0-9]", ""))


def strip_digits_quotes(col) -> Column:
    """Drop ASCII digits and the double quote."""
    return F.regexp_replace(_c(col), '[0-9"]', "")


def _strip_prefixed(col, prefix: str) -> Column:
    # greedy run of non-space characters, backtracked to a word boundary
    return F.regexp_replace(_c(col), U + prefix + NON_WS + r"+\b", "")


def strip_hashtags(col, squeeze: bool = True) -> Column:
    """Remove ``#tag`` up to the last word boundary; collapse spaces."""
    out = _strip_prefixed(col, "#")
    return squeeze_ws(out) if squeeze else out


def strip_mentions(col, squeeze: bool = True) -> Column:
    """Remove ``@user`` up to the last word boundary; collapse spaces."""
    out = _strip_prefixed(col, "@")
    return squeeze_ws(out) if squeeze else out


def strip_urls(col, squeeze: bool = True) -> Column:
    """Remove ``http`` / ``https`` followed by non-space characters."""
    out = F.regexp_replace(_c(col), U + "https?" + NON_WS + "+", "")
    return squeeze_ws(out) if squeeze else out


def split_sentences(col, lang=None) -> Column:
    """Rule-based sentence split -> ``ARRAY<STRING>``.

    A sentence ends at ``.``, ``!`` or ``?`` followed by whitespace, but not at
    the full stop of an abbreviation of the language. ``lang`` is a column of
    language codes; a missing or unknown one follows the English rules.
    """
    text = _c(col)
    if lang is None:
        kept = _keep_abbreviations(text, DEFAULT_LANG_NAME)
    else:
        name, kept = lang_name(lang), _keep_abbreviations(text, DEFAULT_LANG_NAME)
        for other in [n for n in ABBREVIATIONS if n != DEFAULT_LANG_NAME]:
            kept = F.when(name == other, _keep_abbreviations(text, other)).otherwise(kept)
    marked = F.regexp_replace(kept, U + "([.!?])" + WS + "+", "$1" + SENT_MARK)
    return F.split(F.replace(marked, F.lit(ABBR_MARK), F.lit("")), SENT_MARK)


def _keep_abbreviations(text: Column, name: str) -> Column:
    words = "|".join(re.escape(w) for w in ABBREVIATIONS[name])
    return F.regexp_replace(text, f"(?iu)(^|{WS})({words})\\.", "$1$2." + ABBR_MARK)


def dedup_sentences(col, lang=None) -> Column:
    """Strip each sentence, drop exact repeats (first kept), join by ' '."""
    sentences = F.transform(split_sentences(col, lang), py_strip)
    return F.concat_ws(" ", F.array_distinct(sentences))


def clean_text(col, lang=None) -> Column:
    """digits/quotes -> hashtags -> mentions -> urls -> squeeze ->
    sentence dedup -> strip, in this order, as one expression. The input is
    first rendered as text, so a missing value is cleaned as ``'nan'``."""
    t = strip_digits_quotes(as_text(col))
    t = strip_hashtags(t, squeeze=False)
    t = strip_mentions(t, squeeze=False)
    t = strip_urls(t, squeeze=False)
    t = squeeze_ws(t)
    t = dedup_sentences(t, lang)
    return py_strip(t)


def as_text(col) -> Column:
    """P5: ``str(x)`` with a missing value rendered as ``'nan'``."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))


def lang_name(col) -> Column:
    """Language code -> name, default ``english``."""
    pairs = []
    for k, v in LANG_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(col)), F.lit(DEFAULT_LANG_NAME))
