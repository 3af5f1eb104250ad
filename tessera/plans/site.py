"""Queries on what a site shows of its collection and checks of it: Spark plans with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import overview, quality
from tessera.operators.graph import KINDS
from tessera.plans.registry import add, t
from tessera.sources.shared import shared_dir

_ACTIONS = ["Deferred", "First Reading", "Discussed", "Adopted", "Unheard of", ""]


@add("featured_matter", """WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'Motion' ELSE 'Bylaw' END AS type, strftime(o_orderdate, '%Y-%m') || '-01' AS date, CAST(o_custkey AS VARCHAR) || '.' || (o_orderkey % 7) AS number, CAST(o_custkey AS VARCHAR) AS base, (['Deferred', 'First Reading', 'Discussed', 'Adopted', 'Unheard of', ''])[o_orderkey % 6 + 1] AS action FROM orders),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS number, c_name, c_mktsegment, c_acctbal FROM customer),
b AS (SELECT * FROM i WHERE type = 'Bylaw' ORDER BY date DESC, CASE action WHEN 'Deferred' THEN 90 WHEN 'First Reading' THEN 75 WHEN 'Discussed' THEN 65 WHEN 'Adopted' THEN 45 ELSE 50 END DESC, CAST(base AS BIGINT) DESC, k LIMIT 1)
SELECT base AS base_bylaw_number, coalesce(c_name, 'Bylaw ' || base) AS title, CASE action WHEN 'Discussed' THEN 'Council discussion' WHEN '' THEN 'Council discussion' ELSE action END AS status, date AS notice_date, coalesce(c_mktsegment, 'Not identified') AS department, 'https://example.org/bylaws/' || base || '.pdf' AS official_bylaw, 'https://example.org/meetings' AS official_notice, '2026-07-20' AS last_checked FROM b LEFT JOIN r ON r.number = base""")
def featured_matter(spark, sf):
    """The newest month's items; actions that are still discussed come before adopted ones, then the greatest number."""
    o, no = t(spark, sf, "orders"), F.lit(None).cast("string")
    k, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    action = F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (k % 6 + 1).cast("int"))
    items = o.select(
        k.alias("position"), F.when(F.col("o_orderstatus") == "F", "Motion").otherwise("Bylaw").alias("type"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")).alias("date"), F.concat(who, F.lit("."), k % 7).alias("number"), who.alias("base_number"), action.alias("action"),
        *[no.alias(c) for c in ("title", "department", "category", "summary", "source_document_url", "meeting_url", "local_document", "source_kind")],
    )
    records = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("number"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("department"), *[no.alias(c) for c in ("description", "category", "pdf_url", "official_pdf", "source_url")], "c_custkey")
    one = overview.featured_matter(items, records, "position", "c_custkey", "2026-07-20T08:00:00", "https://example.org/meetings", "https://example.org/bylaws/{}.pdf")
    return one.select("base_bylaw_number", "title", "status", "notice_date", "department", "official_bylaw", "official_notice", "last_checked")


@add("record_states", """WITH e AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s, CASE l_returnflag WHEN 'R' THEN 'repealed_by' WHEN 'A' THEN 'amends' ELSE 'consolidates' END AS type FROM lineitem WHERE l_quantity >= 50 AND l_tax < 0.02),
n AS (SELECT k, count(*) AS n, bool_or(type = 'repealed_by') AS r, bool_or(type = 'amends') AS a, bool_or(type = 'consolidates') AS c FROM e GROUP BY k)
SELECT CASE WHEN p_size = 50 OR r THEN 'repealed' WHEN p_size = 49 OR c THEN 'consolidated' WHEN p_size = 48 OR a THEN 'amended' ELSE 'published' END AS state, count(*) AS n, CAST(sum(coalesce(n, 0)) AS BIGINT) AS relationships FROM part LEFT JOIN n ON k = p_partkey GROUP BY 1""")
def record_states(spark, sf):
    """States by the legal status or by any of the lists of relationships, whose sizes are summed."""
    kind = F.when(F.col("l_returnflag") == "R", "repealed_by").when(F.col("l_returnflag") == "A", "amends").otherwise("consolidates")
    edges = t(spark, sf, "lineitem").where("l_quantity >= 50 AND l_tax < 0.02").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("s"), kind.alias("type"))
    lists = edges.groupBy("p_partkey").agg(F.struct(*[F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("s")))).alias(k) for k in KINDS]).alias("relationships"))
    legal = F.when(F.col("p_size") == 50, " Replaced").when(F.col("p_size") == 49, "CONSOLIDATED").when(F.col("p_size") == 48, "Amendment bylaw").otherwise("Published")
    records = t(spark, sf, "part").join(lists, "p_partkey", "left").select(overview.record_state(legal, "relationships").alias("state"), overview.relationship_count("relationships").alias("c"))
    return records.groupBy("state").agg(F.count("*").alias("n"), F.sum("c").alias("relationships"))


@add("dataset_states", """WITH d AS (SELECT s_nationkey AS k, count(*) AS n, bool_or(s_acctbal > 9000) AS required, bool_or(s_acctbal < -900) AS protected, count(*) FILTER (WHERE s_acctbal > 0) >= count(*) * 0.8 AS available FROM supplier GROUP BY 1),
s AS (SELECT *, CASE WHEN protected THEN 'Protected / directory listing disabled' WHEN available THEN 'Available' WHEN required THEN 'Missing' ELSE 'Unavailable' END AS label FROM d), m AS (SELECT count(*) FILTER (WHERE available) || '/' || count(*) AS "count", count(*) FILTER (WHERE required AND NOT available) AS n FROM d)
SELECT CAST(k AS VARCHAR) AS name, label FROM s UNION ALL SELECT "count", CASE WHEN n = 0 THEN 'Required runtime datasets are available' ELSE n || ' required dataset' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' unavailable' END FROM m""")
def dataset_states(spark, sf):
    balance = F.col("s_acctbal")
    sets = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("name")).agg(F.bool_or(balance > 9000).alias("required"), F.bool_or(balance < -900).alias("protected"), (F.count_if(balance > 0) >= F.count("*") * 0.8).alias("available"))
    health = overview.dataset_health(sets)
    return overview.dataset_states(sets).select("name", "label").unionByName(health.select(F.col("count").alias("name"), F.col("status").alias("label")))


@add("collection_times", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 8 THEN NULL WHEN 9 THEN '0' ELSE (['s.generated_at', 's.last_updated', 's.updated_at', 's.collected_at', 'd.generated_at', 'd.collected_at', 'm.generated_at', 'm.last_updated'])[o_orderkey % 10 + 1] || o_custkey END AS collected FROM orders""")
def collection_times(spark, sf):
    """Times under any of four names in the summary, the data or the data's metadata; empty ones are passed over."""
    k, who = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    at = lambda place, name: F.when(k == place, F.concat(F.lit(name), who)).when(k % 2 == 0, "").alias(name[2:])
    none = lambda name: F.lit(None).cast("string").alias(name)
    summary = F.struct(at(0, "s.generated_at"), at(1, "s.last_updated"), at(2, "s.updated_at"), F.when(k == 9, "0").otherwise(at(3, "s.collected_at")).alias("collected_at"))
    data = F.struct(at(4, "d.generated_at"), none("last_updated"), none("updated_at"), at(5, "d.collected_at"), F.struct(at(6, "m.generated_at"), at(7, "m.last_updated")).alias("metadata"))
    return t(spark, sf, "orders").select("o_orderkey", summary.alias("summary"), data.alias("data")).select("o_orderkey", overview.collected_at("summary", "data").alias("collected"))


@add("committee_detail", """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' ORDER BY coalesce(date, '') DESC, o_orderkey LIMIT 100""")
def committee_detail(spark, sf):
    items = t(spark, sf, "orders").withColumn("date", F.when(F.col("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy-MM-dd")))
    return overview.committee_listing(items, F.col("o_orderpriority"), "4-not-specified", 100, "o_orderkey").select("o_orderkey", "date")


@add("index_records", """WITH e AS (SELECT p_partkey AS k, 300 + p_partkey % 700 AS n, p_partkey % 5 AS f, p_name, p_type FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS r FROM e WHERE f <> 4)
SELECT CAST(n AS VARCHAR) AS number, CASE WHEN f = 3 THEN p_name || ' 2019' ELSE p_name || ' Bylaw 1998 No. ' || n END AS title, CASE WHEN f = 3 THEN 2019 ELSE 1998 END AS year, CASE WHEN f < 3 AND k % 2 = 0 THEN 'Animals' ELSE 'Other' END AS category, CASE WHEN f = 3 THEN 'https://example.org/ViewBylaw/' || n || '.pdf' ELSE 'https://example.org/bylaws/x.pdf' END AS official_pdf, 'detail.html?number=' || n AS detail_url FROM f WHERE r = 1""")
def index_records(spark, sf):
    """Numbers come from the words of a link or from its address; the first link of a number counts."""
    k = F.col("p_partkey")
    n, f = (300 + k % 700).cast("string"), k % 5
    title = F.when(f == 3, F.concat("p_name", F.lit(" 2019"))).when(f == 4, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" Bylaw 1998 No. "), n))
    entries = t(spark, sf, "part").select(k.alias("pos"), F.when(f == 3, F.concat(F.lit("/ViewBylaw/"), n, F.lit(".pdf"))).otherwise("x.pdf").alias("href"), title.alias("title"), F.when((f < 3) & (k % 2 == 0), "On animal control").otherwise("").alias("description"))
    found = overview.index_records(entries, "pos", "https://example.org/bylaws/", "2026-07-20T08:00:00")
    return found.select("number", "title", "year", "category", "official_pdf", "detail_url")


@add("shared_header", """WITH p AS (SELECT page_id, page_id % 7 AS k, page_id % 2 = 0 AS deep FROM pages)
SELECT CASE WHEN deep THEN 'a/' ELSE '' END || page_id || '.html' AS path, CASE k WHEN 1 THEN 'root' WHEN 2 THEN 'scripts' WHEN 3 THEN 'address' WHEN 4 THEN 'order' WHEN 5 THEN 'hard-coded' ELSE 'placeholders,hard-coded' END AS errors FROM p WHERE k <> 0""")
def shared_header(spark, sf):
    """Pages with the shared header right, of another root, without script, of an old version, in another order, or of their own."""
    k, deep = F.col("page_id") % 7, F.col("page_id") % 2 == 0
    root = F.when(deep, "..").otherwise(".")
    div = F.concat(F.lit('<div class="x" data-shared-header="" data-root="'), F.when(k == 1, "/").otherwise(root), F.lit('"></div>'))
    script = F.concat(F.lit('<script defer src="'), F.when(deep, "../").otherwise(""), F.lit("shared-header.min.js?v="), F.when(k == 3, "V1").otherwise("V2"), F.lit('"></script>'))
    own = F.lit('<header class="site-header"></header>')
    head = F.when(k == 2, div).when(k == 4, F.concat(script, div)).when(k == 5, F.concat(div, script, own)).when(k == 6, F.concat(script, own)).otherwise(F.concat(div, script))
    pages = t(spark, sf, "pages").select(F.concat(F.when(deep, "a/").otherwise(""), F.col("page_id"), F.lit(".html")).alias("path"), F.concat(head, F.col("html")).alias("html"))
    return quality.shared_header_lint(pages, "path", "html", "V2")


@add("missing_datasets", """SELECT 'fail' AS severity, 'missing-items' AS code, 'Missing or invalid items.json' AS message, NULL AS details UNION ALL SELECT 'fail', 'missing-discussions', 'Missing or invalid discussions.json', NULL
UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END, 'dear-orders', count(*) || ' orders are dear', CASE WHEN count(*) > 0 THEN '[' || string_agg('"' || o_orderkey || '"', ',' ORDER BY o_orderkey) FILTER (WHERE r <= 5) || ']' END FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT 'pass', 'found', count(*) || ' orders', NULL FROM orders""")
def missing_datasets(spark, sf):
    """Of three required files one is whole, one is cut off and one isn't there; other checks carry details or none."""
    place, orders = f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}", t(spark, sf, "orders")
    whole = F.to_json(F.collect_list(F.struct("r_regionkey", "r_name")))
    regions = t(spark, sf, "region")
    regions.agg(whole.alias("value")).coalesce(1).write.text(f"{place}/meetings.json")
    regions.agg(F.substring(whole, 1, 40).alias("value")).coalesce(1).write.text(f"{place}/items.json")
    bad = quality.missing_datasets(spark, {n: f"{place}/{n}.json" for n in ("meetings", "items", "discussions")})
    dear = orders.where("o_totalprice > 400000")
    first = dear.orderBy("o_orderkey").limit(5).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    n = dear.agg(F.count("*").alias("n")).join(F.broadcast(first), F.lit(True))
    listed = n.select(quality.check_row(F.when(F.col("n") > 0, "warn").otherwise("pass"), "dear-orders", F.concat("n", F.lit(" orders are dear")), F.transform("k", lambda x: x.cast("string"))).alias("c")).select("c.*")
    found = orders.agg(quality.check_row("pass", "found", F.concat(F.count("*"), F.lit(" orders")), F.array().cast("array<string>")).alias("c")).select("c.*")
    return bad.unionByName(listed).unionByName(found)


@add("watchlist_values", """WITH l AS (SELECT c_custkey, [c_custkey % 7, 3, c_nationkey, c_custkey % 7, 3] AS v FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') END AS watched FROM l""")
def watchlist_values(spark, sf):
    """Saved lists with repeats, and customers without any."""
    k = F.col("c_custkey")
    saved = F.when(k % 10 != 0, F.array((k % 7).cast("long"), F.lit(3).cast("long"), F.col("c_nationkey").cast("long"), (k % 7).cast("long"), F.lit(3).cast("long")))
    return t(spark, sf, "customer").select("c_custkey", F.array_join(text.ordered_strings(saved), ",").alias("watched"))


@add("title_order", """SELECT p_partkey, row_number() OVER (ORDER BY p_name, CAST(p_partkey AS VARCHAR)) AS place FROM part QUALIFY place <= 300""")
def title_order(spark, sf):
    """The first records by title and number, both compared as they are written."""
    number = F.col("p_partkey").cast("string")
    first = t(spark, sf, "part").orderBy("p_name", number).limit(300)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("p_name", number.alias("number"), "p_partkey"))).alias("l"))
    return listed.select(F.posexplode("l.p_partkey").alias("place", "p_partkey")).select("p_partkey", (F.col("place") + 1).cast("long").alias("place"))
