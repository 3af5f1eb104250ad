"""Reading and writing the archive's tables: lists or objects of rows, snapshots, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.sources.shared import setting
from tessera.sources.versions import Versions


def json_entries(text: Column, key: str | None = None) -> Column:
    """The objects of a JSON text as JSON texts of their own: those of a bare list, or of the list that ``key`` holds in an
    object. Entries that aren't objects are left out, and a text that isn't JSON, or holds no such list, has none."""
    whole = F.try_parse_json(text)
    held = F.try_variant_get(whole, f"$['{key}']", "array<variant>") if key else F.lit(None).cast("array<variant>")
    listed = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), held)
    return F.transform(F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.to_json(x))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """Rows of whole-file JSON: a bare list, or an object whose ``key`` holds the list. A missing path or an
    unreadable file gives no rows; entries are read one by one, and those that aren't objects are dropped. A field that
    doesn't fit its type is null."""
    shape = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], shape)
    entries = files.select(F.explode(json_entries(F.col("value"), key)).alias("e"))
    return entries.select(F.from_json("e", shape).alias("r")).select("r.*")


def write_snapshot(df: DataFrame, root: str, run_date: str, run_time: str) -> None:
    """The immutable snapshot first, then the live table, whose pointer is replaced when all is written: a job that fails
    leaves the old one. A repeated run replaces its own snapshot only."""
    df.write.mode("overwrite").parquet(f"{root}/archive/run_date={run_date}/run_time={run_time}")
    live = Versions(df.sparkSession, f"{root}/live")
    live.publish((live.current() or 0) + 1, {"rows": df})


def read_live(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The live table as last published."""
    return Versions(spark, f"{root}/live").read("rows", schema)


def previous_snapshot(spark: SparkSession, root: str, run_date: str, run_time: str) -> DataFrame:
    """The newest snapshot before a run; only its partition is read."""
    with setting(spark, "spark.sql.sources.partitionColumnTypeInference.enabled", "false"):  # a time is no number: it may begin with 0
        every = spark.read.parquet(f"{root}/archive")
    runs = every.select(F.max(F.when(F.struct(F.col("run_date").cast("string"), F.col("run_time").cast("string")) < F.struct(F.lit(run_date), F.lit(run_time)), F.struct("run_date", "run_time"))).alias("last")).first()["last"]
    if runs is None:
        return every.limit(0).drop("run_date", "run_time")
    return every.where((F.col("run_date") == runs["run_date"]) & (F.col("run_time") == runs["run_time"])).drop("run_date", "run_time")


def file_index(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def require(df: DataFrame, failed, message: str) -> DataFrame:
    """A publish gate: the rows, or an error when ``failed`` (an aggregate) holds."""
    gate = df.agg(F.when(failed, F.raise_error(F.lit(message))).otherwise(F.lit(True)).alias("_ok"))
    return df.join(F.broadcast(gate), F.col("_ok")).drop("_ok")
