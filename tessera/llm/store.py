"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


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


#: Has Spark delete a query's shuffle files when it has ended; what ``cut`` writes replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut", arrow_rows: int = 10_000, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so a lost executor
    costs a reread and not a recomputation. ``arrow_rows`` bounds Arrow batches whose rows hold several texts,
    ``file_rows`` (0: without bound) files whose rows are large."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    with setting(spark, CLEANUP, "true"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows)):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    for scope in _SCOPES[-1:]:
        scope.append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Gathers the tables that ``cut`` writes inside and deletes them at the end; what is taken out of the list stays."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for a table that nothing will read again."""
    path = getattr(df, "_tessera_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
