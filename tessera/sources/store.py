"""Keyed tables that are brought up to date in place: only the partitions that hold a change are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.archive import upsert_plan
from tessera.sources import files

BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of a table with their bucket; a table that isn't there is empty."""
    shape = T.StructType([*[f for f in schema.fields if f.name != BUCKET], T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(shape).parquet(root) if files.exists(spark, root) else spark.createDataFrame([], shape)


def push(local: DataFrame, root: str, key: str, digest: str, buckets: int = 64) -> dict[str, int]:
    """Write the rows of ``local`` whose key is new or whose digest differs; returns the number of keys by action.

    Rows lie in partitions by a hash of the key; there are at most ``buckets`` of them, of which those without a change
    aren't touched. Keys that only the table has stay.
    """
    spark = local.sparkSession
    there = read(spark, root, local.schema)
    plan = upsert_plan(local, there, key, digest).withColumn(BUCKET, bucket_of(key, buckets))
    counts = plan.groupBy("action", BUCKET).agg(F.count("*").alias("n")).collect()  # three actions in each bucket at most
    touched = sorted({r[BUCKET] for r in counts if r["action"] != "skip"})
    if touched:
        new = local.join(plan.where("action <> 'skip'").select(key), key, "left_semi").withColumn(BUCKET, bucket_of(key, buckets))
        kept = there.where(F.col(BUCKET).isin(touched)).join(new.select(key), key, "left_anti")
        _overwrite(kept.unionByName(new), root)
    return {a: sum(r["n"] for r in counts if r["action"] == a) for a in ("upload-new", "upload-changed", "skip")}


def replace_sets(wanted: DataFrame, owners: DataFrame, root: str, owner: str, key: str, buckets: int = 64) -> dict[str, int]:
    """Make the rows of each of ``owners`` those of ``wanted``: missing ones are inserted, others deleted, and equal ones
    left alone. Owners that aren't named keep their rows; partitions without a change keep their files."""
    spark = wanted.sparkSession
    there = read(spark, root, wanted.schema).join(owners.select(owner), owner, "left_semi")
    columns = [c for c in wanted.columns if c not in (owner, key)]
    a = wanted.join(owners.select(owner), owner, "left_semi").select(owner, key, F.struct(F.lit(1), *columns).alias("_new"))
    b = there.select(owner, key, F.struct(F.lit(1), *columns).alias("_old"))
    both = a.join(b, [owner, key], "full_outer").withColumn(BUCKET, bucket_of(owner, buckets))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update").otherwise("keep")
    counts = both.groupBy(action.alias("action"), BUCKET).agg(F.count("*").alias("n")).collect()
    touched = sorted({r[BUCKET] for r in counts if r["action"] != "keep"})
    if touched:
        others = read(spark, root, wanted.schema).where(F.col(BUCKET).isin(touched)).join(owners.select(owner), owner, "left_anti")
        new = wanted.join(owners.select(owner), owner, "left_semi").withColumn(BUCKET, bucket_of(owner, buckets)).where(F.col(BUCKET).isin(touched))
        rows = others.unionByName(new)
        left = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}
        _overwrite(rows, root)
        for bucket in touched:  # a partition without rows isn't overwritten
            if bucket not in left:
                files.delete(spark, f"{root}/{BUCKET}={bucket}")
    return {x: sum(r["n"] for r in counts if r["action"] == x) for x in ("insert", "update", "delete", "keep")}


def _overwrite(rows: DataFrame, root: str) -> None:
    """Put the rows' partitions in the place of those that there are; the others keep their files."""
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(root)
