"""Named catalogue of input tables (S4) and source selection.

An entry is data, not code: where a table lies, its schema, how its columns are
renamed to the common ``(id, comment_text, toxic[, lang])`` and what it is for. A
user registers their own tables by path.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import clean_text
from sluice.operators.sampling import training_labels
from sluice.sources.csv_io import read_csv

ROLES = ("train", "valid", "test", "template", "pool")


def schema_of(ddl: str) -> T.StructType:
    """The schema written as DDL, such as ``id bigint, comment_text string``."""
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Entry:
    """A table at ``path`` as ``csv`` or ``parquet``; ``cleaned_path`` holds its pre-cleaned copy, if there is one."""

    name: str
    path: str
    schema: T.StructType
    renames: Mapping[str, str] = field(default_factory=dict)
    role: str = "train"
    fmt: str = "csv"
    cleaned_path: str | None = None


class Catalog:
    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def register(self, name: str, path: str, schema: T.StructType | str, renames: Mapping[str, str] | None = None,
                 role: str = "train", fmt: str = "csv", cleaned_path: str | None = None) -> Entry:
        """Add a table; a name can be taken once, and renames must name columns of the schema."""
        s = schema_of(schema) if isinstance(schema, str) else schema
        if name in self._entries:
            raise ValueError(f"table {name!r} is already registered")
        if role not in ROLES or fmt not in ("csv", "parquet"):
            raise ValueError(f"unknown role {role!r} or format {fmt!r}")
        if missing := set(renames or {}) - set(s.names):
            raise ValueError(f"renamed columns that the schema of {name!r} lacks: {sorted(missing)}")
        self._entries[name] = e = Entry(name, path, s, dict(renames or {}), role, fmt, cleaned_path)
        return e

    def __getitem__(self, name: str) -> Entry:
        return self._entries[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def load(self, spark: SparkSession, name: str, columns: list[str] | None = None, common: bool = True,
             cleaned: bool = False) -> DataFrame:
        """A registered table, read with its schema and renamed to the common columns.

        ``columns`` prunes by the file's names. ``cleaned`` reads the pre-cleaned
        copy where one is registered, else cleans ``comment_text`` on the way (X10).
        """
        e = self[name]
        path = e.cleaned_path if cleaned and e.cleaned_path else e.path
        if e.fmt == "csv":
            df = read_csv(spark, path, e.schema, columns)
        else:
            df = spark.read.schema(e.schema).parquet(path).select(*(columns or e.schema.names))
        if common and e.renames:
            df = df.withColumnsRenamed({k: v for k, v in e.renames.items() if k in df.columns})
        if cleaned and not e.cleaned_path:
            if "comment_text" not in df.columns:
                raise ValueError("the cleaned variant needs the common column names")
            df = df.withColumn("comment_text", clean_text(F.col("comment_text")))
        return df


#: Names under which ``select_sources`` finds the training tables.
MERGED, SET1, SET2 = "train_merged", "train_set1", "train_set2"
EXTRA = ("train_2018_es", "train_2018_other")


def select_sources(catalog: Catalog, spark: SparkSession, merged: bool = False, extra: bool = False,
                   float_labels: bool = False, threshold: float = 0.95, cleaned: bool = False) -> DataFrame:
    """Flags choose which tables enter training: ``(id, comment_text, toxic, source)``.

    ``merged`` takes the single pre-merged table alone. Otherwise set1, with
    ``extra`` also the 2018 sets, and set2, whose soft labels are floored
    (``float_labels``, L2) or binarised (L1). Missing texts become ``'none'`` (P3).
    """
    names = [MERGED] if merged else [SET1, *(EXTRA if extra else ()), SET2]

    def part(name: str) -> DataFrame:
        df = catalog.load(spark, name, cleaned=cleaned).select("id", "comment_text", "toxic")
        if name == SET2:
            df = training_labels(df, "floor" if float_labels else "binarise", threshold)
        return df.fillna({"comment_text": "none"}).withColumn("source", F.lit(name))

    return reduce(lambda a, b: a.unionByName(b), [part(n) for n in names])
