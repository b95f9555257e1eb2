"""Scoring column functions (Q1, Q2) and the fixed text featurizer.

The reference scores with a fine-tuned transformer. Here scoring is re-aimed
at what Spark runs natively: a linear head over a feature vector. The vector
is either a stored embedding or a small set of text features computed with
built-in string functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.sequences import token_count

# The text feature head (weights, bias).
TEXT_HEAD_WEIGHTS = (0.15, -0.1, 30.0, 4.0)
TEXT_HEAD_BIAS = -0.5


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_features(text) -> Column:
    """``ARRAY<DOUBLE>``: log length, log token count, '!' rate, upper-case rate."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.length(t).cast("double")
    excl = n - F.length(F.regexp_replace(t, "!", "")).cast("double")
    upper = n - F.length(F.regexp_replace(t, r"\p{Lu}", "")).cast("double")
    return F.array(F.log1p(n), F.log1p(token_count(t).cast("double")),
                   excl / (n + 1.0), upper / (n + 1.0))


def head_weights(dim: int, mod: int, shift: int, scale: float = 10.0) -> list[float]:
    """Deterministic weight vector ``((j % mod) - shift) / scale`` for a dim-sized head."""
    return [((j % mod) - shift) / scale for j in range(dim)]


def linear_head(vec, weights: Sequence[float], bias: float) -> Column:
    """Q1: ``vec . w + b`` (weights as an array literal; dropout is identity at scoring)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    prod = F.zip_with(_c(vec), w, lambda a, b: a.cast("double") * b)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x) + F.lit(float(bias))


def softmax_pos(x0, x1) -> Column:
    """Q2: ``softmax([x0, x1])[1]`` = ``1 / (1 + exp(x0 - x1))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(x0) - _c(x1)))
