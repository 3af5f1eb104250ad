"""Tables that are published together: every version in a folder of its own, and one pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources import files

POINTER = "CURRENT"


class Versions:
    """Versioned tables below ``root``.

    A version's tables are written in full before the pointer is replaced by one rename. A job that dies in between leaves
    the current version as it was, and readers never see tables of two versions. Publishing a version that is
    already current, or older, does nothing, so a repeated run changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        found = files.read_text(self.spark, f"{self.root}/{POINTER}")
        return int(found) if found else None

    def path(self, version: int, table: str) -> str:
        return f"{self.root}/version={version:012d}/{table}"

    def read(self, table: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
        """A table of the current version, or of another; without one it is empty."""
        version = self.current() if version is None else version
        if version is None or not files.exists(self.spark, self.path(version, table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(version, table))

    def publish(self, version: int, tables: dict[str, DataFrame]) -> bool:
        """Whether the version was published; what a failed attempt has left of it is written anew."""
        now = self.current()
        if now is not None and version <= now:
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(version, name))
        files.replace_text(self.spark, f"{self.root}/{POINTER}", str(version))
        return True

    def discard_older(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions up to the current one, and what failed attempts have left above it."""
        now = self.current()
        names = [x for x in files.folders(self.spark, self.root) if x.startswith("version=")]
        known = [x for x in names if now is not None and int(x[8:]) <= now]
        for name in [*known[:-keep], *[x for x in names if x not in known]]:
            files.delete(self.spark, f"{self.root}/{name}")
