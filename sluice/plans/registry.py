"""Registry of named queries and their SQL oracles.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables; the oracle, when one exists, is DuckDB SQL over the same tables whose
result must equal the query's (same column names, same rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from sluice.plans import (  # noqa: F401
        q_ingest, q_labels, q_sampling, q_text, q_metrics, q_sequences, q_augment,
        q_scoring, q_sentences, q_streaming, q_bucketed)
