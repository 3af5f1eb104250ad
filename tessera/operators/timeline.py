"""Unified timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dedup import small_join


def unify(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def year_breaks(events: DataFrame, date: str, *order: str) -> DataFrame:
    """Mark, newest first, the first event of every year.

    A year's first event is the latest one, the least by ``order`` on ties: two pre-aggregated passes give a row
    per year, which is joined back, so no year's events meet in one task. Events that agree in the date
    and in ``order`` are marked alike.
    """
    year = F.coalesce(F.nullif(F.substring(F.col(date), 1, 4), F.lit("")), F.lit("Unknown"))
    dated = events.withColumn("year", year)
    latest = dated.groupBy("year").agg(F.max(date).alias("_latest"))
    first = small_join(dated, latest, "year").where(F.col(date).eqNullSafe(F.col("_latest"))).groupBy("year", "_latest").agg(F.min(F.struct(*order)).alias("_first"))
    is_first = F.col(date).eqNullSafe(F.col("_latest")) & F.struct(*order).eqNullSafe(F.col("_first"))
    return small_join(dated, first, "year").withColumn("year_break", is_first).drop("_latest", "_first").select(*events.columns, "year", "year_break")
