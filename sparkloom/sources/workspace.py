"""Where intermediate tables and stream checkpoints go, and settings that hold for a while."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_local: str | None = None


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the cluster shares (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary folder.
    """
    global _local
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local = _local or "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        shared = _local
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **changed: str) -> Iterator[None]:
    """Settings of the session for a while; names are given with ``__`` for dots."""
    before = {}
    for name, value in changed.items():
        name = name.replace("__", ".")
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def listing(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """While a frame over many folders is made: its files are listed by some tasks, not by one for each folder."""
    return settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism="64")
