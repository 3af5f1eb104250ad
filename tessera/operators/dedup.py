"""Deduplication with ranking semantics. Row order is always explicit: callers pass the columns that define it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_best(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: list, position: str) -> DataFrame:
    """First occurrence wins; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list, position: str) -> DataFrame:
    """Last occurrence wins."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_newest(df: DataFrame, keys: list, time: str, position: str) -> DataFrame:
    """The latest wins; of equally late ones the first by (numeric) position."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(time), -F.col(position))).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_ranked(df: DataFrame, keys: list, rank: Column, position: str) -> DataFrame:
    """Highest source rank wins; on ties the last by position. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(rank, F.col(position))).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Groups of several members: key, survivor (the least member), n."""
    groups = df.groupBy(key).agg(F.min(member).alias("survivor"), F.count("*").alias("n"))
    return groups.where("n > 1")


def rewrite_duplicates(df: DataFrame, column: str, canonical: DataFrame) -> DataFrame:
    """Replace values of ``column`` by their canonical ones; ``canonical`` has duplicate, survivor."""
    joined = df.join(canonical, df[column] == canonical.duplicate, "left")
    return joined.withColumns({"rewritten": F.col("survivor").isNotNull(), column: F.coalesce("survivor", column)}).drop("duplicate", "survivor")


def newest_known(sources: list[DataFrame], key: str, position: str) -> DataFrame:
    """The record of each key in the first source that has it (live first, then snapshots, newest first), with its
    source_rank. An aggregate, so copies collapse before the shuffle."""
    every = None
    for rank, source in enumerate(sources):
        ranked = source.withColumn("source_rank", F.lit(rank))
        every = ranked if every is None else every.unionByName(ranked)
    rest = [c for c in every.columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("source_rank", position)).alias("_row"))
    return best.select(key, "_row.*").select(*every.columns)


def small_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", few: int = 100_000) -> DataFrame:
    """A join with a narrow table of a row per key: broadcast if it has ``few`` rows at most by its count, so that keys
    with many rows on the left stay spread; else a plain join."""
    return left.join(F.broadcast(right) if right.count() <= few else right, on, how)
