"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in SETTING. Only a local session without it, as in tests, gets one of its own:
    on a cluster a machine's folder would be read by others in vain."""
    where = spark.conf.get(SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} names no shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
