"""Session construction and the shared scratch location.

Library code never invents its own storage location on a cluster: the
checkpoint / scratch folder is whatever ``spark.checkpoint.dir`` names, and a
session on a cluster without that setting is refused. Only a local master
without it (local runs, tests) gets a private folder. Scratch tables are
removed when the driver process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "sluice") -> SparkSession:
    """A session tuned the way the engine expects (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # checkpoint files of intermediates are removed once nothing refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is; without it the call fails, because a folder on the driver's disk is
    one that executors cannot see. In local runs and tests a fresh folder is
    made and registered for this session only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not is_local(sc.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
    local = tempfile.mkdtemp(prefix="sluice-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, as ``--py-files`` does.

    Functions that run in tasks are imported there by name, so a worker must
    find the package even where the driver was started in another folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sluice_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sluice-package-")) / "sluice.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._sluice_shipped = True


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


_scratch_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder, removed when the driver ends."""
    root = os.path.join(ensure_checkpoint_dir(spark), "sluice-out")
    if root not in _scratch_roots:
        _scratch_roots.add(root)
        atexit.register(remove_scratch, spark, root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_scratch(spark: SparkSession, root: str) -> None:
    """Delete a scratch folder in whatever store it is; a session that has already ended leaves it."""
    _scratch_roots.discard(root)
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from it.

    Used where a plan would otherwise recompute an expensive intermediate in
    several branches (token counts, the sample pool, the encoded set). A
    reliable checkpoint also cuts the lineage, so a lost executor costs a
    re-read, not a recomputation from the source.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
