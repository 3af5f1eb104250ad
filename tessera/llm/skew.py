"""Joins whose frequent keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than one SHARE-th of all rows, is dealt in parts of that many rows.
ROWS, SHARE = 1000, 10_000


def salted_join(left: DataFrame, right: DataFrame, on: str, counted: DataFrame | None = None, how: str = "inner", few: int = 0) -> DataFrame:
    """Inner or left join of ``left`` with ``right``, whose keys repeat little.

    Frequent keys are counted in ``counted`` (by default ``left``), which has the key column and is cheap to
    read. There are at most SHARE of them, as each has more than one SHARE-th of all rows: they are broadcast.
    Their rows of ``left`` get a random part, those of ``right`` are repeated for each part. A ``right`` of narrow
    rows, ``few`` at most by its count, is broadcast instead, so that ``left`` stays where it is.
    """
    if few and right.count() <= few:
        return left.join(F.broadcast(right), on, how)
    counted = left if counted is None else counted
    per = max(ROWS, counted.count() // SHARE)
    hot = counted.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > per).select(on, F.ceil(F.col("_n") / per).cast("int").alias("_parts"))
    if not hot.limit(1).count():
        return left.join(right, on, how)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[c for c in left.columns if c != on]), F.col("_parts").cast("long")).cast("int"))).drop("_parts")
    several = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(several, [on, "_part"], how).drop("_part")
