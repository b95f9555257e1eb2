"""Label column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default label threshold and weight of non-toxic rows.
TOXIC_THRESHOLD = 0.95
LOSS_WEIGHT = 0.9


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binarise(col, threshold: float = TOXIC_THRESHOLD) -> Column:
    """L1: ``(toxic >= T)`` as int; a missing label counts as 0."""
    return F.coalesce((_c(col) >= F.lit(threshold)).cast("int"), F.lit(0))


def floor_below(col, threshold: float = TOXIC_THRESHOLD) -> Column:
    """L2: soft mode -- keep the value when ``>= T``, else 0 (null -> 0)."""
    return F.when(_c(col) >= F.lit(threshold), _c(col)).otherwise(F.lit(0.0))


def round_half_even(col) -> Column:
    """L3: ``round().astype(int)`` with banker's rounding (0.5 -> 0, 1.5 -> 2)."""
    return F.bround(_c(col), 0).cast("int")


def at_least(col, threshold: float = TOXIC_THRESHOLD) -> Column:
    """L4: boolean target before AUC."""
    return _c(col) >= F.lit(threshold)


def class_key(label, lang) -> Column:
    """``str(label) + lang``."""
    return F.concat(_c(label).cast("string"), _c(lang))


def target_pair(toxic, weight) -> Column:
    """``ARRAY<DOUBLE>(toxic, weight)``."""
    return F.array(_c(toxic).cast("double"), _c(weight).cast("double"))


def one_hot(target, size: int = 2) -> Column:
    """Float vector of ``size`` with 1.0 at ``target``."""
    t = _c(target)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: (i == t).cast("float"))
