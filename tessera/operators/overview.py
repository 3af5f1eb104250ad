"""What a site shows of its collection: the featured matter, states of records and datasets, times of collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text, urls
from tessera.operators.dedup import keep_last
from tessera.operators.graph import KINDS

# How much an action counts for the featured matter; those that are still discussed before those that are done.
ACTION_PRIORITY = {
    "Deferred": 90, "Referred": 85, "Amended": 80, "Rescinded": 78, "First Reading": 75, "Second Reading": 74, "Third Reading": 73, "Three Readings": 72, "Reading": 70, "Discussed": 65,
    "Approved": 60, "Endorsed": 58, "Adopted": 45, "Passed": 40, "Received": 30,
}
DEFAULT_PRIORITY = 50


def _literals(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def featured_matter(items: DataFrame, records: DataFrame, position: str, record_position: str, generated_at: str, meetings_url: str, record_url: str) -> DataFrame:
    """One row, or none: the newest bylaw item, of equally new ones that of the highest priority of its action, then of the
    greatest number by its digits, then the first by position; with what its record knows.

    ``items`` are those of extract.items; ``records`` have number, title, description, department, category, pdf_url,
    official_pdf and source_url, of equal numbers the last. ``record_url`` is an address with ``{}`` for the number.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = items.where((F.col("type") == "Bylaw") & ((own("number") != "") | (own("base_number") != ""))).withColumn("_number", text.first_truthy("base_number", "number"))
    digits = F.coalesce(F.try_to_number(F.nullif(F.regexp_replace("_number", "[^0-9]", ""), F.lit("")), F.lit("9" * 38)), F.lit(0))
    rank = F.struct(own("date").alias("d"), F.coalesce(_literals(ACTION_PRIORITY)[own("action")], F.lit(DEFAULT_PRIORITY)).alias("p"), digits.alias("n"), (-F.col(position)).alias("first"))
    fields = [c for c in items.columns if c != position]
    top = named.agg(F.max_by(F.struct("_number", *fields), rank).alias("i")).where("i IS NOT NULL").select("i.*")
    facts = ["title", "description", "department", "category", "pdf_url", "official_pdf", "source_url"]
    known = keep_last(records.select(F.col("number").alias("_key"), *facts, F.col(record_position).alias("_at")), ["_key"], "_at")
    # one row on the left
    for name, key in (("_exact", "number"), ("_base", "_number")):
        top = top.join(known.select(F.col("_key").alias(key), F.struct(*facts).alias(name)), key, "left")
    top = top.withColumn("_r", F.coalesce("_exact", "_base"))
    action = text.first_truthy("action", F.lit("Council discussion"))
    number = F.col("_number")
    return top.select(
        F.lit(generated_at).alias("generated_at"), text.first_truthy("title", "_r.title", F.concat(F.lit("Bylaw "), number)).alias("title"), number.alias("base_bylaw_number"),
        F.when(action == "Discussed", "Council discussion").otherwise(action).alias("status"), action.alias("stage"), F.col("date").alias("notice_date"), text.first_truthy("department", "_r.department", F.lit("Not identified")).alias("department"),
        text.first_truthy("category", "_r.category").alias("category"), text.first_truthy("summary", "_r.description", F.lit("This bylaw was identified in the latest collected Council records.")).alias("summary"),
        text.first_truthy("_r.pdf_url", "_r.official_pdf", "_r.source_url", F.replace(F.lit(record_url), F.lit("{}"), number)).alias("official_bylaw"), text.first_truthy("source_document_url", "meeting_url", F.lit(meetings_url)).alias("official_notice"),
        text.first_truthy("meeting_url", F.lit(meetings_url)).alias("council_documents"), "local_document", "source_kind", F.lit(generated_at[:10]).alias("last_checked"),
    )


# Legal statuses by the state that they are counted under.
STATES = {"repealed": "repealed", "replaced": "repealed", "repealing bylaw": "repealed", "replacement bylaw": "repealed", "consolidated": "consolidated", "amendment bylaw": "amended"}


def record_state(legal_status: Column, relationships: str) -> Column:
    """repealed over consolidated over amended over published, by a record's legal status or its relationships."""
    named = _literals(STATES)[F.lower(F.trim(F.coalesce(legal_status, F.lit(""))))]
    has = lambda kind: F.coalesce(F.size(f"{relationships}.{kind}") > 0, F.lit(False))
    is_ = lambda state: F.coalesce(named == state, F.lit(False))
    return (
        F.when(is_("repealed") | has("repealed_by") | has("replaced_by"), "repealed").when(is_("consolidated") | has("consolidates"), "consolidated")
        .when(is_("amended") | has("amends"), "amended").otherwise("published")
    )


def relationship_count(relationships: str) -> Column:
    """How many relationships of all kinds a record has."""
    return sum((F.coalesce(F.size(f"{relationships}.{k}"), F.lit(0)) for k in KINDS), F.lit(0)).cast("int")


def dataset_states(datasets: DataFrame) -> DataFrame:
    """Datasets (available, required, protected, ..) with ``state`` and the label that it is shown with."""
    state = F.when(F.col("protected"), "protected").when(F.col("available"), "available").when(F.col("required"), "missing").otherwise("optional")
    shown = _literals({"protected": "Protected / directory listing disabled", "available": "Available", "missing": "Missing", "optional": "Unavailable"})
    return datasets.withColumn("state", state).withColumn("label", shown[F.col("state")])


def dataset_health(datasets: DataFrame) -> DataFrame:
    """(count, n_missing, status): available of all, and the required ones that aren't there, said in words."""
    missing = F.count_if(F.col("required") & ~F.col("available"))
    said = F.concat(missing.cast("string"), F.lit(" required dataset"), F.when(missing == 1, "").otherwise("s"), F.lit(" unavailable"))
    count = F.concat_ws("/", F.count_if("available").cast("string"), F.count("*").cast("string"))
    return datasets.agg(count.alias("count"), missing.alias("n_missing"), F.when(missing > 0, said).otherwise("Required runtime datasets are available").alias("status"))


# The fields that tell when data were collected, in order.
TIME_FIELDS = ("generated_at", "last_updated", "updated_at", "collected_at")


def collected_at(summary: str, data: str) -> Column:
    """When a collection was made: the first time that the summary names, else the data, else the data's metadata."""
    listed = [f"{part}.{name}" for part in (summary, data) for name in TIME_FIELDS] + [f"{data}.metadata.{name}" for name in TIME_FIELDS[:2]]
    return text.first_truthy(*listed)


def committee_listing(items: DataFrame, name: Column, slug: str, n: int, position: str) -> DataFrame:
    """The first ``n`` items of the committee with this slug, newest first, equally new ones as they came."""
    return items.where(text.page_slug(name) == slug).orderBy(F.coalesce("date", F.lit("")).desc(), F.col(position)).limit(n)


def index_records(entries: DataFrame, position: str, index: str, generated_at: str) -> DataFrame:
    """Records from the links of an index page (href, title, description, position): the first link of each number counts, and
    links without a number go."""
    href = urls.join(F.lit(index), F.col("href"))
    numbered = entries.withColumn("_href", href).withColumn("number", text.number_from(F.col("title"), F.col("_href"))).where("number IS NOT NULL")
    first = numbered.groupBy("number").agg(F.min_by(F.struct("title", "description", "_href"), F.col(position)).alias("e")).select("number", "e.*")
    number = F.col("number")
    return first.select(
        "number", "title", "description", text.year_from(F.col("title")).alias("year"), text.keyword_category(F.concat_ws(" ", "title", "description")).alias("category"), F.lit("Published").alias("status"), F.col("_href").alias("official_pdf"),
        F.lit(index).alias("official_index"), F.concat(F.lit("pdf/"), number, F.lit(".pdf")).alias("local_pdf"), F.concat(F.lit("detail.html?number="), number).alias("detail_url"), F.lit(generated_at[:10]).alias("last_checked"), F.lit(generated_at).alias("retrieved_at"),
    )
