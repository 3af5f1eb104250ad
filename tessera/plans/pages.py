"""Queries on captured pages, records and overview counts: Spark plans with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, text, urls
from tessera.operators import archive, crawl, facets, quality
from tessera.plans.registry import add, t

_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', {})"


@add("page_links", f"SELECT page_id, unnest({_HREFS.format(1)}) AS href, trim(regexp_replace(unnest({_HREFS.format(2)}), '\\s+', ' ', 'g')) AS label FROM pages")
def page_links(spark, sf):
    return crawl.links(t(spark, sf, "pages"), "page_id", "html").select("page_id", "href", "label")


@add("index_entries", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS b FROM pages)
SELECT page_id, regexp_extract(b, '<a href="([^"]*)"', 1) AS href, trim(regexp_extract(b, '>([^<]*)</a>', 1)) AS title, '' AS description FROM b WHERE contains(regexp_extract(b, '<a href="([^"]*)"', 1), '/a')""")
def index_entries(spark, sf):
    return crawl.index_entries(t(spark, sf, "pages"), "page_id", "html", "/a")


@add("document_candidates", r"""WITH p AS (SELECT page_id, page_id % 3 AS k, regexp_extract_all(html, '(?i)(?:href|src|data)=["'']([^"'']+)["'']', 1) AS own FROM pages),
l AS (SELECT page_id, CASE k WHEN 0 THEN ['/get?download=1', '/x.PDF?a=1&b=2', '/x.PDF?a=1&amp;b=2'] WHEN 1 THEN ['/page.aspx', '/Document/7', '/scan.pdf'] ELSE ['/lazy.pdf'] END || list_filter(own, lambda x: regexp_matches(lower(x), '[.]pdf|download|document|[.]aspx')) AS found FROM p)
SELECT page_id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' ') AS found FROM l""")
def document_candidates(spark, sf):
    """Links, frames and objects with and without quotes come first, then what any tag names: images, and text with entities."""
    k = F.col("page_id") % 3
    more = F.when(k == 0, '<iframe title="x" src="/x.PDF?a=1&amp;b=2"></iframe><a class=b href=/get?download=1>y</a>').when(k == 1, "<object data='/Document/7'></object><img src=\"/scan.pdf\"><A class='z' HREF = /page.aspx >q</A>").otherwise('<img data-src="/lazy.pdf"><p data="/none">')
    return t(spark, sf, "pages").select("page_id", F.array_join(crawl.document_candidates(F.concat(more, "html")), " ").alias("found"))


@add("discovery", """SELECT user_id, event_type, coalesce(arg_min(event_id, event_id) FILTER (WHERE value > 80), min(event_id)) AS event_id FROM events GROUP BY user_id, event_type""")
def discovery(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    found = crawl.discover(e.where("value > 80"), e, ["user_id", "event_type"], "event_id")
    return found.select("user_id", "event_type", "event_id")


@add("documents_by_address", r"""WITH d AS (SELECT page_id % 10 AS meeting, regexp_replace(regexp_replace(url, '\?.*$', '') || '#' || page_id, '#.*$', '') AS address, page_id FROM pages)
SELECT meeting, address, max(page_id) AS page_id FROM d GROUP BY meeting, address""")
def documents_by_address(spark, sf):
    d = t(spark, sf, "pages").select((F.col("page_id") % 10).alias("meeting"), F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("#"), F.col("page_id").cast("string")).alias("url"), "page_id")
    return crawl.last_by_address(d, "meeting", "url", "page_id").select("meeting", "address", "page_id")


@add("document_resolution", """WITH RECURSIVE h AS (SELECT p_partkey AS page, (p_partkey * 7 + p_size) % 97 AS target FROM part),
r AS (SELECT page AS start, page AS "at", [page] AS seen, 0 AS depth FROM h UNION ALL SELECT start, target, list_append(seen, target), depth + 1 FROM r JOIN h ON r.at = page WHERE depth < 3 AND NOT list_contains(seen, target))
SELECT start, max(depth) AS depth, arg_max(r.at, depth) AS page FROM r GROUP BY start""")
def document_resolution(spark, sf):
    hops = t(spark, sf, "part").select(F.col("p_partkey").alias("page"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 97).alias("target"))
    return crawl.resolve(hops.select(F.col("page").alias("start")), hops).withColumnRenamed("at", "page")


@add("source_headers", """SELECT page_id, 'W/' || page_id AS etag, CASE WHEN page_id % 4 = 0 THEN NULL ELSE length(html) END AS length, CASE WHEN page_id % 3 = 0 THEN 'text/html' END AS type FROM pages WHERE page_id % 5 <> 0""")
def source_headers(spark, sf):
    k = F.col("page_id")
    size = F.when(k % 4 == 0, "unknown").otherwise(F.length("html").cast("string"))
    headers = F.map_from_arrays(F.array(F.lit("ETag"), F.lit("CONTENT-LENGTH"), F.when(k % 3 == 0, "content-Type").otherwise("X-Other")), F.array(F.concat(F.lit("W/"), k.cast("string")), size, F.lit("text/html")))
    answer = crawl.source_headers(F.when(k % 5 != 0, headers), F.col("url"))
    return t(spark, sf, "pages").select("page_id", answer.alias("h")).where("h IS NOT NULL").select("page_id", "h.etag", "h.length", "h.type")


@add("page_summaries", r"""WITH p AS (SELECT page_id, 'Council Summary ' || CASE WHEN page_id % 2 = 0 THEN 'July 20, 2026' ELSE 'notes Summary' END AS title, CASE WHEN page_id % 2 = 0 THEN '2026-07-20' ELSE '2025-01-02' END AS date FROM pages)
SELECT page_id, title, date, replace(title, ' Summary', '') AS meeting_title, 'council' AS meeting_group FROM p""")
def page_summaries(spark, sf):
    """The word Summary goes wherever it stands; the date is the title's, else the text's."""
    k = F.col("page_id")
    head = F.concat(F.lit("<h1>Council  Summary "), F.when(k % 2 == 0, "July 20, 2026").otherwise("notes Summary"), F.lit("</h1>"), F.when(k % 2 == 0, "").otherwise("<b>January 2, 2025</b>"))
    pages = t(spark, sf, "pages").select(k.cast("string").alias("url"), F.concat(head, F.regexp_replace("html", "(?s)<h1>.*?</h1>", "")).alias("html"))
    return crawl.summaries(pages, "url", "html").select(F.col("url").cast("long").alias("page_id"), "title", "date", "meeting_title", "meeting_group")


@add("canonical_files", "SELECT l.doc_id, min(d.doc_id) AS canonical FROM labels l JOIN documents x ON x.doc_id = l.doc_id JOIN documents d ON d.text = x.text GROUP BY l.doc_id")
def canonical_files(spark, sf):
    """The archived copy of each labelled document's content."""
    docs = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    known = docs.groupBy("sha").agg(F.min("doc_id").alias("canonical"))
    return docs.join(t(spark, sf, "labels").select("doc_id").distinct(), "doc_id").join(known, "sha").select("doc_id", "canonical")


@add("copy_plan", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'copy-missing' WHEN doc_id % 7 = 0 THEN 'copy-changed' ELSE 'skip' END AS action FROM documents")
def copy_plan(spark, sf):
    docs, k = t(spark, sf, "documents"), F.col("doc_id")
    source = docs.select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    there = docs.where(k % 10 != 0).select("doc_id", (F.length("text") + F.when(k % 14 == 0, 1).otherwise(0)).alias("size"), F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return archive.copy_plan(source, there, "doc_id", "size", "sha")


@add("path_rewrite", """SELECT o_orderkey, 'new/' || o_custkey || '.pdf' AS local_path, CASE WHEN o_orderkey % 2 = 0 THEN 'new/' || o_custkey || '.pdf' ELSE 'keep' END AS archive_path, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_changed FROM orders""")
def path_rewrite(spark, sf):
    orders = t(spark, sf, "orders")
    old = F.concat(F.lit("old/"), F.col("o_custkey").cast("string"), F.lit(".pdf"))
    records = orders.select("o_orderkey", F.replace(old, F.lit("/"), F.lit("\\")).alias("local_path"), F.when(F.col("o_orderkey") % 2 == 0, old).otherwise("keep").alias("archive_path"))
    moved = orders.select(old.alias("duplicate"), F.replace(old, F.lit("old/"), F.lit("new/")).alias("survivor")).distinct()
    return archive.rewrite_paths(records, ["local_path", "archive_path"], moved)


@add("subscription_settings", """SELECT event_id, CASE event_type WHEN 'click' THEN 'daily' WHEN 'view' THEN 'weekly' ELSE 'immediate' END AS frequency, value > 50 AS active, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'c' || user_id % 3 END AS categories FROM events""")
def subscription_settings(spark, sf):
    raw = t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "daily").when(F.col("event_type") == "view", "weekly").otherwise("hourly").alias("frequency"), F.when(F.col("value") > 50, "true").otherwise("no").alias("active"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))).alias("category"))
    clean = raw.select("event_id", text.one_of(F.col("frequency"), ["immediate", "daily", "weekly"], "immediate").alias("frequency"), text.as_boolean(F.col("active")).alias("active"), text.as_list(F.col("category")).alias("categories"))
    return clean.withColumn("categories", F.array_join("categories", ","))


@add("collected_at", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'Unavailable' END AS collected FROM orders")
def collected_at(spark, sf):
    status = F.col("o_orderstatus")
    return t(spark, sf, "orders").select("o_orderkey", text.first_truthy(F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""), F.when(status == "O", F.col("o_orderpriority")), F.lit("Unavailable")).alias("collected"))


@add("search_with_relationships", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'repeals') OR p_size > 25")
def search_with_relationships(spark, sf):
    """The names of a record's relationships are searched along with its fields."""
    relations = F.when(F.col("p_size") > 25, F.struct(F.array(F.col("p_brand")).alias("repeals")))
    return facets.search_records(t(spark, sf, "part"), "Repeals", relations, "p_name").select("p_partkey")


@add("committee_page", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P'")
def committee_page(spark, sf):
    name = F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P"), "  Comité  d'Été & Parks ").otherwise(F.concat(F.lit("Parks "), "o_orderpriority"))
    return t(spark, sf, "orders").where(text.name_slug(name) == "comite-d-ete-parks").select("o_orderkey")


@add("archived_files", """WITH f AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'a/' || o_custkey || '.pdf' WHEN o_orderkey % 4 = 1 THEN 'b/' || o_custkey || '.PDF?v=' || o_orderkey % 3 END AS p FROM orders)
SELECT count(DISTINCT p) AS with_query, count(DISTINCT regexp_replace(p, '[?#].*$', '')) AS without_query FROM f""")
def archived_files(spark, sf):
    k, who = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    first = F.when(k == 0, F.concat(F.lit("a/"), who, F.lit(".pdf"))).otherwise("x.txt")
    second = F.when(k == 1, F.concat(F.lit("b/"), who, F.lit(".PDF?v="), (F.col("o_orderkey") % 3).cast("string")))
    path = facets.first_pdf(first, second)
    return t(spark, sf, "orders").agg(F.countDistinct(path).alias("with_query"), F.countDistinct(F.regexp_replace(path, "[?#].*$", "")).alias("without_query"))


@add("status_histogram", """SELECT CASE WHEN contains(p_type, 'BRASS') THEN 'repealed' WHEN contains(p_type, 'STEEL') THEN 'consolidated' WHEN contains(p_type, 'TIN') THEN 'amended' ELSE 'published' END AS status, count(*) AS n FROM part GROUP BY 1""")
def status_histogram(spark, sf):
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace("p_type", "BRASS", "Repealed, consolidated"), "STEEL", "Consolidated; amended"), "TIN", "Amendment")
    return t(spark, sf, "part").groupBy(facets.status_class(words).alias("status")).agg(F.count("*").alias("n"))


@add("repealed_counts", """WITH e AS (SELECT l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'repeals' WHEN l_returnflag = 'A' THEN 'replaces' ELSE 'amends' END AS type FROM lineitem)
SELECT count(*) FILTER (WHERE type = 'amends') AS n_amendments, count(DISTINCT CASE WHEN type <> 'amends' AND p_size IS NOT NULL THEN target END) AS n_collected, count(DISTINCT CASE WHEN type <> 'amends' AND p_size IS NULL THEN target END) AS n_historical FROM e LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size < 25) ON p_partkey = target""")
def repealed_counts(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "repeals").when(F.col("l_returnflag") == "A", "replaces").otherwise("amends")
    edges = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), kind.alias("type"))
    there = t(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("target"), F.lit(True).alias("_hit"))
    ended = F.col("type").isin("repeals", "replaces")
    joined = edges.join(there, "target", "left")
    return joined.agg(F.count_if(F.col("type") == "amends").alias("n_amendments"), F.countDistinct(F.when(ended & F.col("_hit"), F.col("target"))).alias("n_collected"), F.countDistinct(F.when(ended & F.col("_hit").isNull(), F.col("target"))).alias("n_historical"))


@add("dataset_health", """WITH d AS (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n, true AS required UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), true UNION ALL SELECT 'absent', (SELECT count(*) FROM orders WHERE o_orderkey < 0), true UNION ALL SELECT 'extra', (SELECT count(*) FROM part WHERE p_size < 0), false)
SELECT count(*) FILTER (WHERE n > 0) AS n_available, count(*) FILTER (WHERE n = 0 AND required) AS n_missing, CASE WHEN count(*) FILTER (WHERE n = 0 AND required) > 0 THEN 'Attention' WHEN count(*) FILTER (WHERE n = 0) > 0 THEN 'Partial' ELSE 'Healthy' END AS status FROM d""")
def dataset_health(spark, sf):
    one = lambda name, df, required: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(required).alias("required"))
    orders, part = t(spark, sf, "orders"), t(spark, sf, "part")
    listed = one("orders", orders, True).unionByName(one("pages", t(spark, sf, "pages"), True)).unionByName(one("absent", orders.where("o_orderkey < 0"), True)).unionByName(one("extra", part.where("p_size < 0"), False))
    return quality.health(listed)


@add("overview_counts", """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(DISTINCT text) FROM documents) AS n_documents, (SELECT count(DISTINCT lang) FROM documents) AS n_categories, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS n_years""")
def overview_counts(spark, sf):
    docs = t(spark, sf, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct(F.sha2("text", 256)).alias("n_documents"), F.countDistinct("lang").alias("n_categories"))
    return docs.join(F.broadcast(t(spark, sf, "orders").agg(F.countDistinct(F.year("o_orderdate")).alias("n_years"))), F.lit(True))


@add("item_order", """SELECT r, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END, '') DESC, o_orderstatus DESC, o_orderpriority DESC, o_orderkey) AS r FROM orders) WHERE r <= 30""")
def item_order(spark, sf):
    """The first items by date, type and number, downwards, missing ones last, equal ones as they came."""
    date = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    keys = [F.coalesce(c, F.lit("")).desc() for c in (date, F.col("o_orderstatus"), F.col("o_orderpriority"))]
    first = t(spark, sf, "orders").orderBy(*keys, "o_orderkey").limit(30)
    listed = first.agg(F.collect_list(F.struct(F.coalesce(date, F.lit("")).alias("d"), "o_orderstatus", "o_orderpriority", (-F.col("o_orderkey")).alias("k"))).alias("l"))
    return listed.select(F.posexplode(F.reverse(F.array_sort("l")))).select((F.col("pos") + 1).cast("long").alias("r"), (-F.col("col.k")).alias("o_orderkey"))


_PATHS = ["data/a.json", "data/a.pdf", "council/a.TXT", "archive/%s.pdf", "archive/%s.html", "collection-status.json", "council/pdf"]


@add("cache_rules", f"""WITH k AS (SELECT page_id, replace(unnest([{', '.join(repr(x) for x in _PATHS)}]), '%s', CAST(page_id AS VARCHAR)) AS key FROM pages)
SELECT page_id, key, CASE WHEN key LIKE 'data/%' THEN 'public, max-age=60, must-revalidate' WHEN lower(key) LIKE '%.pdf' OR lower(key) LIKE '%.txt' THEN 'public, max-age=3600' ELSE 'public, max-age=300, must-revalidate' END AS stored,
  CASE WHEN key = 'collection-status.json' THEN 'public, max-age=30, s-maxage=60, must-revalidate' WHEN key LIKE 'data/%' THEN 'public, max-age=60, s-maxage=300, must-revalidate' WHEN lower(key) LIKE '%.pdf' OR lower(key) LIKE '%.txt' THEN 'public, max-age=3600, s-maxage=86400' ELSE 'public, max-age=300, s-maxage=900, must-revalidate' END AS answered,
  CASE lower(regexp_extract(key, '[.]([a-zA-Z]+)$', 1)) WHEN 'json' THEN 'application/json' WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' ELSE 'application/octet-stream' END AS media FROM k""")
def cache_rules(spark, sf):
    every = t(spark, sf, "pages").select("page_id", F.explode(F.array(*[F.replace(F.lit(x), F.lit("%s"), F.col("page_id").cast("string")) for x in _PATHS])).alias("key"))
    return every.select("page_id", "key", urls.cache_control(F.col("key")).alias("stored"), urls.answer_cache_control(F.col("key")).alias("answered"), urls.content_type(F.col("key")).alias("media"))


@add("label_forms", """SELECT o_orderkey, 'status-' || CASE o_orderstatus WHEN 'F' THEN 'repealed' WHEN 'O' THEN 'first-reading' ELSE 'new' END AS css, '7' || o_orderkey AS number FROM orders""")
def label_forms(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "Repealed").when(F.col("o_orderstatus") == "O", "First Reading").otherwise("New")
    return t(spark, sf, "orders").select("o_orderkey", urls.status_class(status).alias("css"), text.normalize_number(F.concat(F.lit(" 7"), F.col("o_orderkey").cast("string"), F.lit(".. "))).alias("number"))


@add("unknown_labels", "SELECT count(DISTINCT o_orderpriority) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS labels FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unknown_labels(spark, sf):
    return quality.unknown(t(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("n", F.array_join("labels", ",").alias("labels"))


@add("discussions", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'detail/' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'local/' || o_custkey WHEN o_orderkey % 4 = 2 THEN 'source' ELSE 'meeting' END AS url, 'Order ' || o_orderkey AS title, o_orderpriority AS category FROM orders""")
def discussions(spark, sf):
    k, who = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    url = text.first_truthy(F.when(k == 0, F.concat(F.lit("detail/"), who)), F.when(k <= 1, F.concat(F.lit("local/"), who)).otherwise(""), F.when(k == 2, "source"), F.lit("meeting"))
    title = text.first_truthy(F.lit(""), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
    return t(spark, sf, "orders").select("o_orderkey", url.alias("url"), title.alias("title"), text.first_truthy("o_orderpriority", F.lit("Other")).alias("category"))
