"""Tables bucketed and sorted by their join keys (J1, J2, J3 without a shuffle).

Scores, templates and pools are written once and joined again and again: by every
ensemble, every submission, every epoch. Two tables with the same number of buckets
on the same keys join bucket by bucket as they are read, and an aggregate by those
keys needs no exchange either. Writing shuffles the rows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from sluice.session import scratch_path


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` as table ``name`` in ``buckets`` buckets by ``keys``, one sorted file each; returns the table.

    Rows are dealt to the buckets before they are written, so that a task writes one
    file and not one per bucket. Choose ``buckets`` as the table's size divided by 128 to
    256 MB, alike for the tables that meet. All rows of one key are in one bucket: the
    keys are meant to be ids, or places in a pool. Without ``path`` the files are scratch
    and go when the driver ends; without ``name`` the table gets one of its own.
    """
    spark = df.sparkSession
    name = name or f"sluice_bucketed_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path or scratch_path(spark, "bucketed")).saveAsTable(name))
    return spark.table(name)
