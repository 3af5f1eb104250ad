"""Faceted search: substring search, exact facets, counts over fixed domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Case-folded substring search in the joined fields."""
    needle = query.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))) if needle else df


def with_facets(df: DataFrame, **chosen) -> DataFrame:
    """Exact facets; an empty choice passes."""
    tests = [F.col(c).cast("string") == str(v) for c, v in chosen.items() if v not in ("", None)]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def counts_over(df: DataFrame, value: Column, domain: list[str], name: str = "category") -> DataFrame:
    """Rows per value of a fixed domain, zeros included."""
    cards = df.sparkSession.createDataFrame([(x,) for x in domain], f"{name} string")
    found = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return F.broadcast(cards).join(found, name, "right").union(cards.join(found, name, "left_anti").withColumn("n", F.lit(0).cast("long"))).where(F.col(name).isin(domain))


def search_records(df: DataFrame, query: str, relationships: Column, *columns: str) -> DataFrame:
    """Substring search in the joined fields and in the relationships as JSON, names included: a record without any has
    an empty object, and a missing field reads ``undefined``."""
    needle = query.strip().lower()
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("undefined")) for c in columns]
    whole = F.lower(F.concat_ws(" ", *fields, F.coalesce(F.to_json(relationships), F.lit("{}"))))
    return df.where(F.contains(whole, F.lit(needle))) if needle else df


def first_pdf(*paths: Column) -> Column:
    """The first of the paths that names a PDF, with its query."""
    return F.coalesce(*[F.when(p.rlike(r"(?i)\.pdf(?:$|[?#])"), p) for p in paths])


def status_class(c: Column) -> Column:
    """Repealed over consolidated over amended over published, by the words of a status."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("repeal|replac"), "repealed").when(low.contains("consolidat"), "consolidated").when(low.contains("amend"), "amended").otherwise("published")


def in_year(df: DataFrame, date: str, year: str) -> DataFrame:
    """Rows whose date begins with the year's digits; an empty choice passes."""
    return df.where(F.coalesce(F.col(date), F.lit("")).startswith(year)) if year else df


def domain(df: DataFrame, facet: str, value: Column) -> DataFrame:
    return df.select(F.lit(facet).alias("facet"), value.cast("string").alias("value")).where("value IS NOT NULL AND value <> ''").distinct()


def distinct_identity(df: DataFrame, *candidates: Column) -> DataFrame:
    """Number of distinct values of the first non-empty candidate, trimmed and lower-cased."""
    identity = F.lower(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])))
    return df.agg(F.countDistinct(identity).alias("n"))
