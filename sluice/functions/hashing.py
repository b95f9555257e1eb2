"""Keyed hashes that stand in for random draws.

Every "random" decision of the engine is a pure function of row key, a salt
naming the decision, a seed and (optionally) an epoch or slot number:

    h = md5(concat_ws('|', key, salt, seed[, extra...]))
    u32 = first 8 hex digits of h as an integer in [0, 2^32)
    uniform = u32 / 2^32 in [0, 1)

The value does not depend on partitioning, task retries or executor loss, it
can be pushed through filters by Catalyst (it is deterministic), and DuckDB
computes the identical number, which is what the SQL oracle relies on.
Keys must be integers or strings; doubles print differently across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _lit_or_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def keyed_md5(key, salt: str, seed: int = 42, *extra) -> Column:
    """Hex md5 of ``key|salt|seed[|extra...]``."""
    parts = [_lit_or_col(key).cast("string"), F.lit(salt), F.lit(str(seed))]
    parts += [_lit_or_col(e).cast("string") for e in extra]
    return F.md5(F.concat_ws("|", *parts))


def u32(key, salt: str, seed: int = 42, *extra) -> Column:
    """Unsigned 32-bit draw (as BIGINT) from the first 8 hex digits."""
    return F.conv(F.substring(keyed_md5(key, salt, seed, *extra), 1, 8), 16, 10).cast("bigint")


def uniform(key, salt: str, seed: int = 42, *extra) -> Column:
    """Draw in [0, 1)."""
    return u32(key, salt, seed, *extra) / F.lit(TWO_POW_32)


def gate(key, salt: str, p: float, seed: int = 42, *extra) -> Column:
    """True with probability ``p`` per key (M7)."""
    return uniform(key, salt, seed, *extra) < F.lit(float(p))


def draw_int(key, salt: str, lo: int, hi: int, seed: int = 42, *extra) -> Column:
    """Integer uniform in [lo, hi] inclusive, like ``random.randint``."""
    return F.lit(lo) + F.pmod(u32(key, salt, seed, *extra), F.lit(hi - lo + 1))


# --- SQL text of the same functions, for the DuckDB oracle ------------------

def sql_md5(key_sql: str, salt: str, seed: int = 42, *extra_sql: str) -> str:
    parts = [key_sql, f"'{salt}'", f"'{seed}'", *extra_sql]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_u32(key_sql: str, salt: str, seed: int = 42, *extra_sql: str) -> str:
    return f"CAST(('0x' || substr({sql_md5(key_sql, salt, seed, *extra_sql)}, 1, 8)) AS BIGINT)"


def sql_uniform(key_sql: str, salt: str, seed: int = 42, *extra_sql: str) -> str:
    return f"({sql_u32(key_sql, salt, seed, *extra_sql)} / 4294967296.0)"
