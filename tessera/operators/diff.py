"""Snapshot differences, change events and bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.functions.hashes import fingerprint


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str], if_known: tuple[str, ...] = ()) -> DataFrame:
    """Added, removed and changed keys: key, change_type, changed_fields and before_/after_ values.

    One full outer join on the key; values are compared null-safely, but those of ``if_known`` (hashes) only where
    both sides have one.
    """
    a = before.select(key, *[F.col(f).alias(f"before_{f}") for f in fields], F.lit(True).alias("_a"))
    b = after.select(key, *[F.col(f).alias(f"after_{f}") for f in fields], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    unequal = lambda f: F.col(f"before_{f}") != F.col(f"after_{f}") if f in if_known else ~F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
    differs = [F.when(unequal(f), F.lit(f)) for f in fields]
    changed = F.filter(F.array(*differs), lambda x: x.isNotNull())
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.withColumns({"change_type": kind, "changed_fields": F.when(kind == "changed", changed)})
    return out.where("change_type IS NOT NULL").drop("_a", "_b")


def item_set_diff(before: DataFrame, after: DataFrame, identity: Column, fields: list[str]) -> DataFrame:
    """(id, change_type) of items by their identity: added, removed, or changed in any of the fields, which are
    compared by one fingerprint."""
    side = lambda df, name: df.groupBy(identity.alias("id")).agg(F.max(fingerprint(*[F.col(f) for f in fields])).alias(name))
    both = side(before, "_a").join(side(after, "_b"), "id", "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("id", kind.alias("change_type")).where("change_type IS NOT NULL")


#: What a table of changes can be sorted by: the key, and what decides between equal ones.
CHANGE_ORDERS = {"number": ["number"], "status": ["status", "-date"], "category": ["category", "-date"], "date": ["date"]}


def sorted_changes(df: DataFrame, key: str, ascending: bool, n: int, *ties: Column) -> DataFrame:
    """The first ``n`` changes by one of CHANGE_ORDERS. Status and category compare without case; equal ones are newest
    first in either direction."""
    first, *then = CHANGE_ORDERS[key]
    value = F.lower(F.coalesce(F.col(first), F.lit(""))) if then else F.col(first)
    return newest(df, n, value.asc_nulls_last() if ascending else value.desc_nulls_last(), *[F.desc(x[1:]) for x in then], *ties)


def event_status(change_type: Column, searchable: Column, relationships_changed: Column | None = None) -> Column:
    """New, Repealed, Consolidated or Amended. A changed set of relationships always reads as a repeal, because its
    field names are searched along with its values."""
    low = F.lower(F.coalesce(searchable, F.lit("")))
    repealed = low.rlike("repeal|replaced")
    if relationships_changed is not None:
        repealed = repealed | relationships_changed
    return F.when(change_type == "added", "New").when(change_type == "removed", "Repealed").when(repealed, "Repealed").when(low.contains("consolidat"), "Consolidated").otherwise("Amended")


#: A log of changes to records.
EVENTS = "id string, date string, date_precision string, change_type string, status string, number string, title string, category string, year int, detail_url string, changed_fields array<string>, baseline boolean"


def event_order() -> list[Column]:
    """Newest first; in a run those added, changed and removed, by number; of a baseline the newest record first."""
    kind = F.when(F.col("change_type") == "added", 1).when(F.col("change_type") == "changed", 2).when(F.col("change_type") == "removed", 3).otherwise(0)
    return [F.coalesce("date", F.lit("")).desc(), kind.asc(), F.col("number").asc()]


def _page(number: Column) -> Column:
    return F.concat(F.lit("detail.html?number="), number)


def change_events(changes: DataFrame, at: str) -> DataFrame:
    """Rows of EVENTS of a ``snapshot_diff`` of records (number, title, description, category, year, detail_url, legal_status,
    relationships as JSON text).

    Added and removed records speak for themselves. Of a changed one only the title and the fields that have changed are told:
    its category is Other unless that has changed, and its year is unknown.
    """
    kind, number = F.col("change_type"), F.col("number").cast("string")
    has = lambda f: F.array_contains("changed_fields", f)
    whole = lambda f: F.when(kind == "added", F.col(f"after_{f}")).when(kind == "removed", F.col(f"before_{f}"))
    differing = lambda f: F.when(has(f), text.first_truthy(f"after_{f}", f"before_{f}"))
    told = lambda f: F.when(kind == "changed", differing(f)).otherwise(whole(f))
    title = F.when(kind == "changed", text.first_truthy("after_title", "before_title")).otherwise(whole("title"))
    relations = F.when(has("relationships"), F.col("after_relationships"))
    rewritten = ~F.coalesce(relations, F.lit("")).isin("", "{}", "null")
    said = F.concat_ws(" ", F.when(has("legal_status"), F.col("after_legal_status")), title)
    status = event_status(kind, said, F.coalesce((kind == "changed") & rewritten, F.lit(False)))
    year = F.when(kind == "changed", F.when(has("year"), F.coalesce("after_year", "before_year"))).otherwise(whole("year"))
    page = F.when(kind == "changed", _page(number)).otherwise(text.first_truthy(whole("detail_url"), _page(number)))
    return changes.select(
        F.concat_ws(":", F.lit(at), kind, number).alias("id"), F.lit(at).alias("date"), F.lit(None).cast("string").alias("date_precision"), kind, status.alias("status"), number.alias("number"),
        text.first_truthy(title, F.concat(F.lit("Bylaw "), number)).alias("title"), text.first_truthy(told("category"), F.lit("Other")).alias("category"), year.cast("int").alias("year"), page.alias("detail_url"),
        F.when(kind == "changed", F.array_sort("changed_fields")).alias("changed_fields"), F.lit(False).alias("baseline"),
    )


#: What the statuses of records read as in a first log.
BASELINE = {"Repealed": "Repealed", "Replaced": "Repealed", "Repealing bylaw": "Repealed", "Replacement bylaw": "Repealed", "Consolidated": "Consolidated", "Amendment bylaw": "Amended"}


def baseline_events(records: DataFrame, n: int = 40) -> DataFrame:
    """Rows of EVENTS for the newest ``n`` records by year and by the numbers in their number, for a log without changes."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(F.col("number").cast("string"), F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    top = newest(records, n, F.coalesce("year", F.lit(0)).desc(), parts.desc(), F.col("number").asc())
    named = F.create_map(*[F.lit(x) for pair in BASELINE.items() for x in pair])
    relation = lambda kind: F.coalesce(F.get_json_object("relationships", f"$.{kind}[0]").isNotNull(), F.lit(False))
    legal = text.first_truthy("legal_status", F.lit("Published"))
    status = F.when(named[legal] == "Repealed", "Repealed").when((named[legal] == "Consolidated") | relation("consolidates"), "Consolidated").when((named[legal] == "Amended") | relation("amends"), "Amended").otherwise("New")
    number, year = F.col("number").cast("string"), F.col("year").cast("int")
    dated = F.coalesce(year, F.lit(0)) != 0
    return top.select(
        F.concat(F.lit("baseline:"), number).alias("id"), F.when(dated, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01"))).otherwise(F.col("retrieved_at") if "retrieved_at" in records.columns else F.lit(None).cast("string")).alias("date"), F.when(dated, "year").otherwise("collected").alias("date_precision"),
        F.lit("baseline").alias("change_type"), status.alias("status"), number.alias("number"), text.first_truthy("title", F.concat(F.lit("Bylaw "), number)).alias("title"), text.first_truthy("category", F.lit("Other")).alias("category"), year.alias("year"),
        text.first_truthy("detail_url", _page(number)).alias("detail_url"), F.lit(None).cast("array<string>").alias("changed_fields"), F.lit(True).alias("baseline"),
    )


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ``order``: each task sends its own best ``n`` at most."""
    return df.orderBy(*order).limit(n)


def bounded_log(log: DataFrame, new: DataFrame, n: int, *order: Column) -> DataFrame:
    return newest(log.unionByName(new), n, *order)


def last_positions(df: DataFrame, n: int, position: str) -> DataFrame:
    """The last ``n`` rows by position, in ascending order."""
    return newest(df, n, F.col(position).desc()).orderBy(position)


def transitions(df: DataFrame, key: str, position: list[str], active: Column) -> DataFrame:
    """Rows with ``activated``: active now and not in the row before of the same key."""
    window = Window.partitionBy(key).orderBy(*position)
    return df.withColumn("_now", active).withColumn("activated", F.col("_now") & ~F.coalesce(F.lag("_now").over(window), F.lit(False))).drop("_now")
