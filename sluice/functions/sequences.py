"""Token-sequence column functions (T3-T9): pure array expressions.

Special ids are fixed: 0 pad, 1 unknown, 2 start (cls), 3 end (sep); real
tokens are numbered from 4 by the vocabulary job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special token ids, sequence length, length-bucket width.
PAD_ID = 0
UNK_ID = 1
CLS_ID = 2
SEP_ID = 3
FIRST_TOKEN_ID = 4
MAX_LEN = 192
BUCKET_WIDTH = 64

# word runs (letters, digits, underscore) or single punctuation / symbol marks
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[\p{P}\p{S}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """Lower-cased word / punctuation tokens, ``ARRAY<STRING>``."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text) -> Column:
    return F.size(tokenize(text))


def add_markers(ids, cls: int = CLS_ID, sep: int = SEP_ID) -> Column:
    return F.concat(F.array(F.lit(cls)), _c(ids), F.array(F.lit(sep)))


def cut_tokens(tokens, max_len: int, mode: str = "head_tail") -> Column:
    """The tokens (markers excluded) that a truncation to ``max_len`` ids or fewer can keep."""
    if mode not in ("head_tail", "inner", "right"):
        raise ValueError(f"unknown truncation {mode!r}")
    a, m = _c(tokens), max_len - 2
    head, tail = (m, 0) if mode == "right" else (max_len // 2 - 1, max_len - max_len // 2 - 1) if mode == "head_tail" else (m // 2, m - m // 2)
    cut = F.concat(F.slice(a, 1, head), F.slice(a, F.size(a) - tail + 1, tail)) if tail else F.slice(a, 1, head)
    return F.when(F.size(a) > m, cut).otherwise(a)


def truncate_head_tail(ids, max_len: int = MAX_LEN) -> Column:
    """Longer than L (markers included) -> first ``L//2`` + last ``L - L//2``."""
    a = _c(ids)
    head = max_len // 2
    tail = max_len - head
    cut = F.concat(F.slice(a, 1, head), F.slice(a, F.size(a) - tail + 1, tail))
    return F.when(F.size(a) > max_len, cut).otherwise(a)


def truncate_inner(tokens, max_len: int = MAX_LEN, cls: int = CLS_ID, sep: int = SEP_ID) -> Column:
    """T4: keep ``L-2`` inner tokens (head half, tail the rest), then add markers."""
    a = _c(tokens)
    m = max_len - 2
    head = m // 2
    tail = m - head
    cut = F.concat(F.slice(a, 1, head), F.slice(a, F.size(a) - tail + 1, tail))
    return add_markers(F.when(F.size(a) > m, cut).otherwise(a), cls, sep)


def truncate_right(ids, max_len: int = MAX_LEN, sep: int = SEP_ID) -> Column:
    """T5: plain ``max_length`` cut that keeps the end marker."""
    a = _c(ids)
    return F.when(F.size(a) > max_len,
                  F.concat(F.slice(a, 1, max_len - 1), F.array(F.lit(sep)))).otherwise(a)


def pad_right(ids, max_len: int = MAX_LEN, pad: int = PAD_ID) -> Column:
    """Append pad ids up to L (none when already L or longer)."""
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(a), F.lit(0))))


def attention_mask(ids) -> Column:
    """1 per real token, 0 per pad."""
    return F.transform(_c(ids), lambda x: (x > 0).cast("int"))


def token_type_ids(max_len: int = MAX_LEN) -> Column:
    """Zeros of length L."""
    return F.array_repeat(F.lit(0), max_len)


def token_length(mask) -> Column:
    """``sum(mask)``."""
    return F.aggregate(_c(mask), F.lit(0), lambda acc, x: acc + x)


def pad_count(ids) -> Column:
    """Number of pad ids."""
    return F.size(F.filter(_c(ids), lambda x: x == 0))


def nonzero_length(ids) -> Column:
    return F.size(F.filter(_c(ids), lambda x: x != 0))
