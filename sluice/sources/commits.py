"""Sinks that a repeated or restarted run completes instead of doubling.

A commit record is a file that is created exclusively, once what it stands for is
in place. Records live beside the data, in whatever store the path is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.operators.ranking import join_groups
from sluice.session import materialize


class Store:
    """The few file operations that the sinks need, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(sc._jsc.hadoopConfiguration())

    def names(self, path: str) -> set[str]:
        p = self._path(path)
        return {s.getPath().getName() for s in self._fs.listStatus(p)} if self._fs.exists(p) else set()

    def stamp(self, path: str) -> str:
        """Name, length and time of change of a file: another one once it is written anew."""
        s = self._fs.getFileStatus(self._path(path))
        return f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}"

    def record(self, path: str) -> bool:
        """Create an empty file; False if it is there already."""
        return self._fs.createNewFile(self._path(path))


def append_log(df: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Put rows into the log at ``path``, one per ``keys`` (e.g. run, epoch, split).

    Keys that are text (run, split) name folders; the others (epoch), of which there may be
    many, are told apart by the rows, so files do not grow in number with them. A folder
    is replaced as a whole when the job commits: by the given rows and, of its old ones,
    those with other keys. So an append that is repeated, by a retry or a second run, leaves
    one row per key; other keys stay. Appends to one folder follow each other; those to
    different folders may run side by side. A key that is twice in ``df`` is refused.
    """
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"a key {tuple(keys)} is there twice")
    spark = df.sparkSession
    folders = [k for k in keys if isinstance(df.schema[k].dataType, StringType)] or list(keys)
    if set(folders) != set(keys) and Store(spark, path).names(path):
        log = read_log(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
        log = join_groups(log, df.select(*folders).distinct(), folders, "left_semi")
        df = materialize(df.unionByName(join_groups(log, df.select(*keys), keys, "left_anti")))
    # a file in each folder
    df.repartition(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    return path


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def split_id(store: Store, file: str) -> str:
    return hashlib.md5(store.stamp(file).encode()).hexdigest()


def score_files(files: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, wave: int = 64) -> int:
    """Score the input files of ``files``, a DataFrame read from files, in jobs of ``wave`` files; returns the number of files scored now.

    Each input file has a folder of parts, put in place when its job commits, and
    then a record in ``path/_manifest``. A run that was killed is called again: it reads only files
    without a record, and what a killed job left behind is replaced. A file that was
    written anew since is another one. ``score`` maps rows to the rows to keep and
    must keep no state between files. A file without rows gets its record too.
    """
    spark, store = files.sparkSession, Store(files.sparkSession, path)
    done = store.names(f"{path}/_manifest")
    todo = {f: s for f in sorted(files.inputFiles()) if (s := split_id(store, f)) not in done}
    names = list(todo)
    for i in range(0, len(names), wave):
        some = {f: todo[f] for f in names[i:i + wave]}
        # one plan per file, so that only these files are opened and each row knows its split
        parts = [score(spark.read.schema(files.schema).parquet(f)).withColumn("split", F.lit(s)) for f, s in some.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{path}/parts")
        for s in some.values():
            store.record(f"{path}/_manifest/{s}")
    return len(names)


def scored_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all files with a record; parts that a killed job left without one are not read."""
    done = sorted(Store(spark, path).names(f"{path}/_manifest"))
    rows = spark.read.schema(f"{schema}, split string").parquet(f"{path}/parts")
    return rows.join(spark.createDataFrame([(d,) for d in done], "split string"), "split", "left_semi").drop("split")
