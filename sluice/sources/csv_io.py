"""CSV sources and sinks (S1-S3, S5-S8) with explicit schemas.

Comment tables arrive as CSV with a header row and quoted, multi-line text.
Reading never infers a schema (an extra pass and unstable types): every
column is read as text under the declared names, pandas' missing-value
tokens are mapped to null, then the declared types are applied. Multi-line
CSV cannot be split inside a file, so large inputs should be many files --
or, better, landed once as Parquet (``sources/registry.py``) and read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings pandas reads as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null")

#: Text keeps its leading and trailing white space; Spark's writer trims it unless told not to.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_OPTIONS = KEEP_SPACE | {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             columns: list[str] | None = None, na_tokens=PANDAS_NA_TOKENS) -> DataFrame:
    """Header CSV with quoted multi-line fields; ``columns`` prunes (``usecols``)."""
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.schema(as_text).options(**CSV_OPTIONS).csv(path)
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    if columns is not None:
        order = {c: i for i, c in enumerate(columns)}
        fields.sort(key=lambda f: order[f.name])
    cols = []
    for f in fields:
        c = F.col(f.name)
        c = F.when(c.isin(list(na_tokens)), F.lit(None)).otherwise(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """S3: fail the query if ``key`` repeats (``index_col`` semantics).

    The duplicate count is a scalar subquery; the failure is raised inside
    the plan, no driver collect.
    """
    dups = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
            .agg(F.count(F.lit(1)).alias("_dups")))
    guard = F.when(dups.scalar() > 0, F.raise_error(F.lit(f"duplicate values in key column {key}")))
    return df.filter(F.coalesce(guard.cast("boolean"), F.lit(True)))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV, one part file per task (task-unique names)."""
    df.write.mode(mode).options(**{k: v for k, v in CSV_OPTIONS.items() if k != "mode"}).csv(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> str:
    """One output folder per value of ``by`` (e.g. per scored model)."""
    w = df.write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        w.options(header="true", quote='"', escape='"', **KEEP_SPACE).csv(path)
    else:
        w.parquet(path)
    return path


def part_files(df: DataFrame) -> DataFrame:
    """Which part file each row came from."""
    return df.withColumn("part_file", F.input_file_name())
