"""Session settings the operators are written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

# Shuffle partitions that a session starts with. AQE merges those that turn out small, so this only
# has to be large enough: 4,000 hold 100 MB each of a shuffle of 400 GB. ``session`` takes another.
PARTITIONS = 4000
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# AQE sizes shuffle partitions at run time and splits those a heavy join key makes large.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # spares a stack trace per column expression; wide reports build hundreds of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(
    app: str = "tidemark", master: str | None = None, partitions: int = PARTITIONS, **conf: str
) -> SparkSession:
    """Session with ``SETTINGS`` and any ``conf``; ``master`` only for local runs.

    ``partitions`` is the number of shuffle partitions before small ones are merged.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    initial = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions)}
    for key, value in {**SETTINGS, **initial, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory in the folder that every executor sees.

    The cluster names that folder in ``spark.checkpoint.dir``. Without it there is none to rely on:
    a folder of this machine is not the executors', so this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder all executors see")
    return f"{root.rstrip('/')}/tidemark-{purpose}-{uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within the block the files of a job's shuffles go when it ends, not when the driver collects garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
