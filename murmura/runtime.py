"""Session defaults, shared scratch tables and size checks.

Iterative operators cut their lineage by writing each round as a Parquet table
below the folder named by ``spark.checkpoint.dir``. A written table survives the
loss of any executor, is computed once, and carries file statistics, so the next
round is planned with real sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""Rows up to which a side may be broadcast or held by a task."""


def session(app: str = "murmura", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; keyword settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; made up only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="murmura-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/murmura/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes = {"lock": Lock(), "open": 0, "before": None}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each query inside drops its shuffle files when it ends, not when the driver collects garbage.

    For writes: what they shuffled is never read again, and the files would fill the disks beside
    the tables. Several threads may write at once; the last one restores the setting.
    """
    with _writes["lock"]:
        if not _writes["open"]:
            _writes["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writes["open"] += 1
    try:
        yield
    finally:
        with _writes["lock"]:
            _writes["open"] -= 1
            if not _writes["open"]:
                spark.conf.set(CLEANUP, _writes["before"])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of steps that do not need each other, their jobs run side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return list(pool.map(lambda step: step(), map(inheritable_thread_target(spark), steps)))


def within_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose row count was checked."""
    return F.broadcast(df) if within_rows(df, limit) else df
