"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Wide scoring stages generate methods the JVM would otherwise leave uncompiled.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}

#: Shuffle files of a query go when it has ended, not when the driver's memory is cleaned.
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A task holds that many files of a partitioned write open, so its rows are not sorted by folder (and spilled) first.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "16"}
#: Rows that come sorted by their key are grouped as they pass; no groups are kept, sorted or spilled.
SORTED_GROUPS = {"spark.sql.execution.replaceHashWithSortAgg": "true"}

#: A compressed file holds several times as much as its size tells, so a task takes fewer of them.
COMPRESSED_FILES = {"spark.sql.files.maxPartitionBytes": "16m"}


def build_session(app: str = "dugout", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries run inside; afterwards they are as before."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary one is used only where that is unset and Spark runs in one process, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="dugout-")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder so that a lost executor costs no recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
