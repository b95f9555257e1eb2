"""SQL text fragments for the DuckDB oracle.

The oracle is an independent statement of each operator's semantics in plain
SQL over the same driver tables. These helpers spell out the shared pieces
(derived tables, the keyed hash, the text cleaning chain) once so every
oracle query uses the same definitions.
"""

from __future__ import annotations

from sluice.functions.hashing import sql_u32, sql_uniform  # noqa: F401  (re-exported)
from sluice.functions.text import ABBREVIATIONS, LANG_NAMES

# Python's whitespace (str.isspace) written out for RE2, whose \s is ASCII.
WS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NON_WS = "[^" + WS[1:]

COMMENTS = """(SELECT d.doc_id AS id, d.text AS comment_text, CAST(l.toxic AS DOUBLE) AS toxic,
                d.lang AS lang, d.source AS source
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SET1 = f"(SELECT * FROM {COMMENTS} c WHERE source IN ({', '.join(repr(f'src{i}') for i in range(10))}))"
SET2 = f"(SELECT * FROM {COMMENTS} c WHERE source IN ({', '.join(repr(f'src{i}') for i in range(10, 20))}))"
VALID = f"(SELECT * FROM {COMMENTS} c WHERE id % 5 = 0)"

POOL_SOURCE = """(SELECT conv_id * 1000 + turn AS id, text AS comment_text,
                CAST(turn % 2 AS DOUBLE) AS toxic, 'en' AS lang FROM conversations)"""

METRIC_ROWS = """(SELECT event_id, event_id // 100 AS step,
                CAST(event_type = 'error' AS INTEGER) AS y,
                value / 500.0 AS score, value AS loss, 1 AS n FROM events)"""


def soft_set2() -> str:
    u = sql_uniform("id", "soft")
    return (f"(SELECT id, comment_text, CASE WHEN toxic = 1 THEN round(0.5 + {u} / 2, 2) "
            f"WHEN {u} < 0.2 THEN round({u}, 2) ELSE 0.0 END AS toxic, lang, source FROM {SET2} s)")


def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"


def squeeze_ws(expr: str) -> str:
    return rx(expr, WS + "+", " ")


def py_strip(expr: str) -> str:
    return rx(expr, "^" + WS + "+|" + WS + "+$", "")


def squeeze_spaces(expr: str) -> str:
    return f"trim({squeeze_ws(expr)}, ' ')"


def strip_digits_quotes(expr: str) -> str:
    return rx(expr, '[0-9"]')


def strip_numbers(expr: str) -> str:
    return squeeze_ws(rx(expr, "[0-9]"))


def strip_hashtags(expr: str, squeeze: bool = True) -> str:
    out = rx(expr, "#" + NON_WS + r"+\b")
    return squeeze_ws(out) if squeeze else out


def strip_mentions(expr: str, squeeze: bool = True) -> str:
    out = rx(expr, "@" + NON_WS + r"+\b")
    return squeeze_ws(out) if squeeze else out


def strip_urls(expr: str, squeeze: bool = True) -> str:
    out = rx(expr, "https?" + NON_WS + "+")
    return squeeze_ws(out) if squeeze else out


def _keep_abbreviations(expr: str, name: str) -> str:
    words = "|".join(w.replace(".", "[.]") for w in ABBREVIATIONS[name])
    return f"regexp_replace({expr}, '(?i)(^|{WS})({words})[.]', '\\1\\2.' || chr(2), 'g')"


def split_sentences(expr: str, lang: str | None = None) -> str:
    kept = _keep_abbreviations(expr, "english")
    if lang:
        cases = " ".join(f"WHEN '{code}' THEN {_keep_abbreviations(expr, name)}" for code, name in LANG_NAMES.items() if name != "english")
        kept = f"CASE {lang} {cases} ELSE {kept} END"
    marked = f"regexp_replace({kept}, '([.!?])" + WS + r"+', '\1' || chr(1), 'g')"
    return f"string_split(replace({marked}, chr(2), ''), chr(1))"


def _stripped_sentences(expr: str, lang: str | None = None) -> str:
    return f"list_transform({split_sentences(expr, lang)}, lambda lam_s: {py_strip('lam_s')})"


def dedup_sentences(expr: str, lang: str | None = None) -> str:
    lst = _stripped_sentences(expr, lang)
    return (f"array_to_string(list_filter({lst}, lambda lam_x, lam_i: list_position({lst}, lam_x) = lam_i), ' ')")


def clean_text(expr: str, lang: str | None = None) -> str:
    t = strip_digits_quotes(f"coalesce(CAST({expr} AS VARCHAR), 'nan')")
    t = strip_hashtags(t, squeeze=False)
    t = strip_mentions(t, squeeze=False)
    t = strip_urls(t, squeeze=False)
    t = squeeze_ws(t)
    t = dedup_sentences(t, lang)
    return py_strip(t)


# --- tokens and sequences ------------------------------------------------------

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[\p{P}\p{S}]"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_PATTERN}')"


def vocab_cte(size: int, source: str = "documents", text: str = "text") -> str:
    """``vocab(token, token_id, cnt)``: top ``size`` tokens, ids from 4."""
    h = sql_u32("token", "vocab")
    return f"""vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, h, token) + 3 AS INTEGER) AS token_id, cnt
  FROM (SELECT token, count(*) AS cnt, {h} AS h
        FROM (SELECT unnest({tokens(text)}) AS token FROM {source} s) t GROUP BY token) c
  QUALIFY row_number() OVER (ORDER BY cnt DESC, h, token) <= {size})"""


def encoded_cte(source: str, key: str, text: str, name: str = "enc") -> str:
    """``{name}({key}, tokens)``: vocabulary ids in text order, unknown -> 1 (needs ``vocab``)."""
    return f"""{name}_t AS (
  SELECT {key}, unnest(tk) AS token, unnest(generate_series(1, len(tk))) AS pos
  FROM (SELECT {key}, {tokens(text)} AS tk FROM {source} s) a),
{name} AS (
  SELECT s.{key}, coalesce(list(CAST(coalesce(v.token_id, 1) AS INTEGER) ORDER BY t.pos)
                           FILTER (WHERE t.pos IS NOT NULL), []) AS tokens
  FROM {source} s LEFT JOIN ({name}_t t LEFT JOIN vocab v ON t.token = v.token) ON s.{key} = t.{key}
  GROUP BY s.{key})"""


def head_tail(expr: str, L: int) -> str:
    h, t = L // 2, L - L // 2
    return (f"(CASE WHEN len({expr}) > {L} THEN list_concat({expr}[1:{h}], "
            f"{expr}[len({expr}) - {t} + 1:len({expr})]) ELSE {expr} END)")


def with_markers(expr: str) -> str:
    return f"list_concat([2], {expr}, [3])"


def pad_to(expr: str, L: int) -> str:
    return f"(CASE WHEN len({expr}) < {L} THEN list_resize({expr}, {L}, 0) ELSE {expr} END)"
