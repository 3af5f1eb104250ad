"""Queries on publishing, alert selection, collection checks and reuse decisions: Spark plans with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, hashes, text, urls
from tessera.operators import alerts, archive, diff, facets, quality
from tessera.plans.registry import add, t

ALLOWED = ["click", "purchase", "view", "new"]


def _subscriptions(spark, sf):
    """Subscriptions by account: active with a high value, the kinds of event it had, and times of which some miss."""
    e = t(spark, sf, "events")
    per = e.groupBy("user_id").agg(F.max("value").alias("top"), F.sort_array(F.collect_set("event_type")).alias("kinds"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per.select(F.col("user_id").alias("uid"), (F.col("top") > 60).alias("active"), "kinds", F.when(F.col("top") > 90, F.col("first")).alias("activated"), F.when(F.col("top") > 75, F.col("last")).alias("created"), F.col("first").alias("made"))


def _accounts(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), F.upper("c_name"), F.lit("@Example.org "))).alias("email"))


@add("recipients", f"""WITH s AS (SELECT user_id AS uid, max(value) AS top, list_sort(list(DISTINCT event_type)) AS kinds, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1)
SELECT lower(c_name) || '@example.org' AS recipient, array_to_string(list_filter(kinds, lambda k: k IN ({', '.join(f"'{x}'" for x in ALLOWED)})), ',') AS kinds, strftime(CASE WHEN top > 90 THEN first WHEN top > 75 THEN last ELSE first END, '%Y-%m-%d %H:%M:%S') AS activation_at
FROM s JOIN customer ON c_custkey = uid WHERE top > 60 AND c_acctbal > 0 AND len(list_filter(kinds, lambda k: k IN ({', '.join(f"'{x}'" for x in ALLOWED)}))) > 0""")
def recipients(spark, sf):
    known = alerts.resolve_recipients(_subscriptions(spark, sf), _accounts(spark, sf), "uid", "email", "kinds", ALLOWED)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = dates.activation(iso("activated"), iso("created"), iso("made"))
    return known.select("recipient", F.array_join("kinds", ",").alias("kinds"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("activation_at"))


@add("digests", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events)
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 5) AS shown, count(*) AS n_items, greatest(count(*) - 5, 0) AS n_more FROM r GROUP BY user_id""")
def digests(spark, sf):
    done = alerts.digest(t(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 5)
    return done.select("user_id", F.array_join(F.transform("shown", lambda x: x.cast("string")), ",").alias("shown"), "n_items", F.col("n_more").cast("long").alias("n_more"))


@add("collection_checks", """WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_chars < 100) AS failed, count(*) FILTER (WHERE lang <> 'de') AS local, count(*) FILTER (WHERE lang <> 'de' AND n_chars > 400) AS extracted, count(*) FILTER (WHERE text LIKE '%|%') AS ocr FROM documents)
SELECT CASE WHEN failed = n AND n > 0 THEN 'fail' WHEN failed > 0 THEN 'warn' ELSE 'pass' END AS severity, 'download-failures' AS code, CAST(failed AS DOUBLE) AS value FROM d
UNION ALL SELECT CASE WHEN n > 0 AND local = 0 THEN 'warn' ELSE 'pass' END, 'pdf-download-mode', CAST(local AS DOUBLE) FROM d
UNION ALL SELECT CASE WHEN extracted / CAST(local AS DOUBLE) < 0.7 THEN 'warn' ELSE 'pass' END, 'text-extraction-coverage', round(extracted / CAST(local AS DOUBLE), 6) FROM d
UNION ALL SELECT CASE WHEN ocr > 0 THEN 'warn' ELSE 'pass' END, 'ocr-failures', CAST(ocr AS DOUBLE) FROM d
UNION ALL SELECT CASE WHEN n > 40 THEN 'fail' ELSE 'pass' END, 'discussion-limit', CAST(n AS DOUBLE) FROM d""")
def collection_checks(spark, sf):
    local = F.col("lang") != "de"
    return quality.report(
        t(spark, sf, "documents"), quality.failures("download-failures", F.col("n_chars") < 100, all_fail=True), quality.nothing("pdf-download-mode", local),
        quality.ratio("text-extraction-coverage", local & (F.col("n_chars") > 400), local), quality.failures("ocr-failures", F.col("text").contains("|")), quality.at_most("discussion-limit", 40),
    )


@add("extraction_methods", "SELECT coalesce(lang, 'none') AS method, count(*) AS n FROM documents GROUP BY 1")
def extraction_methods(spark, sf):
    return t(spark, sf, "documents").groupBy(text.first_truthy("lang", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


@add("committee_sizes", """WITH s AS (SELECT (SELECT count(*) FROM part WHERE contains(lower(p_type), 'brass')) AS i, (SELECT count(*) FROM part WHERE contains(p_type, 'BRASS') AND p_size < 40) AS k)
SELECT CASE WHEN i > 0 AND k = 0 THEN 'fail' WHEN i <> k THEN 'warn' ELSE 'pass' END AS severity, CASE WHEN i > 0 AND k = 0 THEN 'committee-dataset-empty' ELSE 'committee-dataset-count' END AS code, CAST(k AS DOUBLE) AS value FROM s
UNION ALL SELECT CASE WHEN i > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN i > 0 THEN 'committee-dataset-empty' ELSE 'committee-dataset-count' END, 0 FROM s""")
def committee_sizes(spark, sf):
    part = t(spark, sf, "part")
    brass = part.where(F.col("p_type").contains("BRASS"))
    names = ("committee-dataset-empty", "committee-dataset-count")
    return quality.combine(quality.same_size(brass, brass.where("p_size < 40"), *names), quality.same_size(brass, brass.where("p_size > 1000"), *names))


@add("featured_checks", """WITH f AS (SELECT CAST(max(o_orderkey) AS VARCHAR) AS number FROM orders)
SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem, f WHERE CAST(l_orderkey AS VARCHAR) = f.number) THEN 'pass' ELSE 'warn' END AS severity, 'featured-source-match' AS code, CAST(1 AS DOUBLE) AS value
UNION ALL SELECT 'fail', 'featured-number', 1.0 UNION ALL SELECT 'warn', 'featured-missing', 0.0
UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM part, f WHERE CAST(p_partkey AS VARCHAR) = f.number || '0') THEN 'pass' ELSE 'warn' END, 'featured-source-match', 1.0""")
def featured_checks(spark, sf):
    last = t(spark, sf, "orders").agg(F.max("o_orderkey").cast("string").alias("number"))
    items = t(spark, sf, "lineitem")
    one = lambda chosen, rows, key: quality.featured(F.col("number"), chosen, rows, key)
    none, empty = last.where("false"), last.withColumn("number", F.lit(""))
    return quality.combine(one(last, items, "l_orderkey"), one(empty, items, "l_orderkey"), one(none, items, "l_orderkey"), one(last.withColumn("number", F.concat("number", F.lit("0"))), t(spark, sf, "part"), "p_partkey"))


@add("required_objects", "SELECT k AS key FROM (VALUES ('en'), ('de'), ('zz'), ('xx/index')) v(k) WHERE k NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def required_objects(spark, sf):
    return quality.absent(["en", "de", "zz", "xx/index"], t(spark, sf, "documents").select(F.col("lang").alias("key")), "key")


@add("check_details", "SELECT string_agg(v, ',' ORDER BY v) FILTER (WHERE r <= 20) AS shown, count(*) AS n_values FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_totalprice > 150000))")
def check_details(spark, sf):
    bad = t(spark, sf, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").cast("string").alias("v"))
    return quality.details(bad, "v").select(F.array_join("values", ",").alias("shown"), "n_values")


@add("header_lint", r"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS heads, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links, strpos(html, '<title>') AS a, strpos(html, '<a href="') AS b FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN len(heads) <> 1 THEN 'placeholders' WHEN heads[1] <> 'Home' THEN 'root' END, CASE WHEN len(links) <> 1 THEN 'scripts' WHEN links[1] <> '/' THEN 'address' END, CASE WHEN len(heads) > 0 AND len(links) > 0 AND strpos(html, '<title>' || heads[1] || '</title>') > strpos(html, '<a href="' || links[1] || '"') THEN 'order' END) AS errors FROM p
WHERE len(heads) <> 1 OR heads[1] <> 'Home' OR len(links) <> 1 OR links[1] <> '/' OR a > b""")
def header_lint(spark, sf):
    return quality.header_lint(t(spark, sf, "pages"), "page_id", "html", "<title>([^<]*)</title>", '<a href="([^"]*)"', F.lit("Home"), F.lit("/"))


@add("page_extraction", r"""WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN substr(text, 1, 60) ELSE text END AS a, text AS o FROM conversations),
c AS (SELECT conv_id, length(regexp_replace(coalesce(a, ''), '[^A-Za-z0-9]', '', 'g')) AS n, length(regexp_replace(coalesce(o, ''), '[^A-Za-z0-9]', '', 'g')) AS m, coalesce(a, '') AS a, o FROM p),
d AS (SELECT conv_id, n < 80 AS sparse, n < 80 AND m > n AS ocr, length(trim(CASE WHEN n < 80 AND m > n THEN o ELSE a END)) AS l FROM c),
s AS (SELECT conv_id, count(*) AS n_pages, count(*) FILTER (WHERE sparse) AS n_sparse, count(*) FILTER (WHERE ocr) AS n_ocr, sum(l) AS l FROM d GROUP BY conv_id)
SELECT conv_id, n_pages, n_sparse, n_ocr, CASE WHEN n_ocr > 0 AND n_ocr = n_pages THEN 'ocr' WHEN n_ocr > 0 THEN 'hybrid' WHEN l > 0 THEN 'embedded' ELSE 'none' END AS method FROM s""")
def page_extraction(spark, sf):
    pages = t(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "user", F.substring("text", 1, 60)).otherwise(F.col("text")).alias("text"), F.col("text").alias("ocr_text"))
    return archive.page_extraction(pages, "conv_id")


@add("record_overlay", """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'new' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def record_overlay(spark, sf):
    orders = t(spark, sf, "orders")
    names = F.when(F.col("o_totalprice") > 150000, F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority"))).when(F.col("o_totalprice") > 100000, F.array(F.lit("o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    over = orders.select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.lit("new").alias("o_orderpriority"), names.alias("present"))
    return archive.overlay(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), over, "o_orderkey", "present")


_CATEGORY = {"1-URGENT": "Transportation & Parking", "2-HIGH": "Finance", "3-MEDIUM": "Land Use & Zoning", "5-LOW": "Animals"}
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORY.items()) + " ELSE 'Unheard of' END"


@add("departments", f"""SELECT category, department, count(*) AS n FROM (SELECT replace({_CASE}, 'Transportation & Parking', 'Transportation') AS category,
CASE WHEN o_orderstatus = 'P' THEN 'Explicit' ELSE CASE {_CASE} WHEN 'Transportation & Parking' THEN 'Engineering & Public Works' WHEN 'Finance' THEN 'Finance' WHEN 'Land Use & Zoning' THEN 'Development Services' WHEN 'Animals' THEN 'Bylaw Services' ELSE 'Corporate Services' END END AS department FROM orders) GROUP BY ALL""")
def departments(spark, sf):
    category = F.expr(_CASE)
    explicit = F.when(F.col("o_orderstatus") == "P", "Explicit").otherwise("")
    return t(spark, sf, "orders").groupBy(text.normalize_category(category).alias("category"), text.department(explicit, category).alias("department")).agg(F.count("*").alias("n"))


@add("year_prefix", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996")
def year_prefix(spark, sf):
    return facets.in_year(t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")), "date", "1996").select("o_orderkey")


@add("meeting_links", """SELECT o_orderkey FROM orders WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P') AND o_orderkey % 3 <> 1""")
def meeting_links(spark, sf):
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "REGULAR Council").when(F.col("o_orderpriority") == "2-HIGH", "the Task Force meets").otherwise("Home")
    context = F.when(F.col("o_orderstatus") == "P", "Public Hearing")
    href = F.element_at(F.array(F.lit("/Meeting.aspx"), F.lit("/about"), F.lit("/x?ID=7")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t(spark, sf, "orders").where(urls.is_meeting_link(label, context, href)).select("o_orderkey")


_FILES = ["data/%s.json", "council/%s.pdf", "council/pdf/%s.pdf", "drafts/%s.pdf", "archive/%s.LOG", "archive/2026/index.html", "archive/%s.html", "bylaws/pdf/%s.sqlite3", "council/x/Desktop.ini", "bylaws/pdf/%s.js", "archive/.log", "data/../%s.json", "archive/a.log/%s.txt"]


@add("published_files", f"""WITH k AS (SELECT page_id, replace(unnest([{', '.join(repr(x) for x in _FILES)}]), '%s', CAST(page_id AS VARCHAR)) AS key FROM pages), n AS (SELECT *, lower(split_part(key, '/', -1)) AS name FROM k)
SELECT page_id, key, (key LIKE 'data/%' OR key LIKE 'archive/%' OR key LIKE 'bylaws/pdf/%' OR key LIKE 'council/%/%') AND name NOT IN ('index.html', 'list.js', 'detail.html', 'detail.js', 'web.config', '.gitkeep', 'desktop.ini', 'thumbs.db')
  AND NOT (strpos(substr(name, 2), '.') > 0 AND '.' || split_part(name, '.', -1) IN ('.pyc', '.tmp', '.log', '.db', '.sqlite', '.sqlite3')) AS publishable, NOT contains(key, '..') AND (key LIKE 'data/%' OR key LIKE 'archive/%' OR key LIKE 'bylaws/pdf/%' OR key LIKE 'council/%') AS allowed FROM n""")
def published_files(spark, sf):
    number = F.col("page_id").cast("string")
    every = t(spark, sf, "pages").select("page_id", F.explode(F.array(*[F.replace(F.lit(x), F.lit("%s"), number) for x in _FILES])).alias("key"))
    return every.select("page_id", "key", urls.is_publishable(F.col("key")).alias("publishable"), urls.is_allowed_key(F.col("key")).alias("allowed"))


@add("pdf_contents", "SELECT page_id, page_id % 3 = 0 AS is_pdf, url LIKE 'http://%' OR url LIKE 'https://%' AS remote FROM pages")
def pdf_contents(spark, sf):
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  %PDF-1.7 "), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x%PDF-"), "html")).otherwise(F.col("html"))
    return t(spark, sf, "pages").select("page_id", urls.is_pdf(content).alias("is_pdf"), urls.is_remote(F.col("url")).alias("remote"))


@add("authored_pages", r"""WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, path <> 'en' AND NOT starts_with(path, 'en/') AS authored, CASE WHEN contains(path, '/') THEN '..' ELSE '.' END AS root FROM p""")
def authored_pages(spark, sf):
    path = F.expr(r"ltrim('/', regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1))")
    return t(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", urls.is_authored_page(F.col("path"), ("en",)).alias("authored"), urls.expected_root(F.col("path")).alias("root"))


_PATHS = ["archive/a b.pdf", "council/x.pdf?y=1", "../archive/z.PDF#p", "https://h.example/q.pdf", "bylaws/pdf/7.txt", ""]
_PATH = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PATHS)) + " END"


@add("record_links", f"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'archive/a b.pdf' WHEN 1 THEN 'council/x.pdf' WHEN 2 THEN 'archive/z.PDF' ELSE '' END AS local, o_orderpriority AS title, o_custkey AS number FROM orders),
v AS (SELECT *, CASE WHEN local = '' THEN '' ELSE 'pdf.html?file=' || replace(url_encode(local), '%20', '+') || '&title=' || replace(url_encode(title), '%20', '+') || '&context=Archived+source+document&number=' || number END AS viewer FROM r)
SELECT o_orderkey, viewer, CASE WHEN o_orderkey % 4 = 0 THEN 'bylaws/detail.html?number=1' WHEN viewer <> '' THEN viewer WHEN o_orderkey % 4 = 1 THEN 'https://s.example/d' WHEN o_orderkey % 4 = 2 THEN 'http://m.example/' ELSE '#' END AS link, CASE o_orderkey % 6 WHEN 0 THEN 'archive/a b.pdf' WHEN 1 THEN 'council/x.pdf' WHEN 2 THEN 'archive/z.PDF' ELSE '' END AS committee FROM v""")
def record_links(spark, sf):
    k = F.col("o_orderkey") % 4
    rows = t(spark, sf, "orders").select("o_orderkey", F.expr(_PATH).alias("path"), "o_orderpriority", F.col("o_custkey").cast("string").alias("number"))
    rows = rows.withColumn("viewer", urls.viewer_url(F.col("path"), F.col("o_orderpriority"), F.lit(None).cast("string"), F.col("number")))
    link = urls.primary_url(F.when(k == 0, "bylaws/detail.html?number=1").otherwise("javascript:alert(1)"), F.col("viewer"), F.when(k == 1, "https://s.example/d").otherwise("ftp://s.example"), F.when(k == 2, "http://m.example/"))
    return rows.select("o_orderkey", "viewer", link.alias("link"), urls.committee_pdf(F.col("path")).alias("committee"))


_ORDERS = [(key, ascending) for key in diff.CHANGE_ORDERS for ascending in (True, False)]


def _order_sql(key: str, ascending: bool) -> str:
    direction = "ASC" if ascending else "DESC"
    by = {"number": f"number {direction} NULLS LAST", "status": f"status {direction}, date DESC", "category": f"category {direction}, date DESC", "date": f"date {direction}"}[key]
    return f"SELECT '{key} {direction.lower()}' AS list, o_orderkey FROM (SELECT * FROM c ORDER BY {by}, o_orderkey LIMIT 12)"


@add("change_orders", "WITH c AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN -1e300 ELSE o_custkey + (o_orderkey % 100) / 100000.0 END AS number, lower(o_orderstatus) AS status, lower(o_orderpriority) AS category, o_orderdate AS date FROM orders) " + " UNION ALL ".join(_order_sql(*x) for x in _ORDERS))
def change_orders(spark, sf):
    number = F.when(F.col("o_custkey") % 7 == 0, "none").otherwise(F.concat(F.lit("No. "), F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 100).cast("string")))
    changes = t(spark, sf, "orders").select("o_orderkey", text.numeric_key(number).alias("number"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("date"))
    every = None
    for key, ascending in _ORDERS:
        one = diff.sorted_changes(changes, key, ascending, 12, F.asc("o_orderkey")).select(F.lit(f"{key} {'asc' if ascending else 'desc'}").alias("list"), "o_orderkey")
        every = one if every is None else every.unionByName(one)
    return every


@add("watch_toggle", """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY user_id)
SELECT user_id, array_to_string(CASE WHEN list_contains(k, 'click') THEN list_filter(k, lambda x: x <> 'click') ELSE list_append(k, 'click') END, ',') AS kinds FROM s""")
def watch_toggle(spark, sf):
    sets = t(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"))
    return sets.select("user_id", F.array_join(text.toggle(F.col("k"), F.lit("click")), ",").alias("kinds"))


@add("file_set", "SELECT DISTINCT lang || '/' || source AS key FROM documents WHERE n_chars > 100 OR n_chars < 5000")
def file_set(spark, sf):
    d = t(spark, sf, "documents").select(F.concat_ws("/", "lang", F.col("source").cast("string")).alias("key"), "n_chars")
    return archive.file_set(d.where("n_chars > 100"), d.where("n_chars < 5000"), key="key")


@add("committee_names", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN 'Named' ELSE 'Committee, board or panel' END AS name FROM orders")
def committee_names(spark, sf):
    status = F.col("o_orderstatus")
    return t(spark, sf, "orders").select("o_orderkey", text.committee_name(F.when(status == "F", F.concat(F.lit(" "), "o_orderpriority")).otherwise(""), F.when(status == "O", "Named ")).alias("name"))


@add("change_labels", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '—' WHEN 1 THEN strftime(ts, '%Y') ELSE strftime(timezone('America/Vancouver', timezone('UTC', ts)), '%b %-d, %Y') END AS label FROM events")
def change_labels(spark, sf):
    k = F.col("event_id") % 4
    return t(spark, sf, "events").select("event_id", dates.change_date_label(F.when(k != 0, F.col("ts").cast("timestamp")), F.when(k == 1, "year")).alias("label"))


@add("reuse_actions", """WITH r AS (SELECT page_id, page_id % 7 <> 0 AS existing, page_id % 5 = 0 AS moved, page_id % 3 = 0 AS anew, page_id % 2 = 0 AS known, page_id % 4 = 0 AS placed, page_id % 11 = 0 AS sized FROM pages)
SELECT page_id, CASE WHEN NOT existing OR moved OR sized THEN CASE WHEN NOT anew THEN 'downloaded-deduplicated' WHEN known THEN 'downloaded-changed' ELSE 'downloaded-new' END WHEN placed THEN 'reused' WHEN anew THEN 'archive-repaired' ELSE 'reused' END AS action FROM r""")
def reuse_actions(spark, sf):
    k = F.col("page_id")
    sized = archive.length_changed(F.lit(""), F.length("html").cast("string"), F.lit("Application/PDF"), F.length("html") + F.when(k % 11 == 0, 1).otherwise(0))
    action = archive.reuse_action(k % 7 != 0, (k % 5 == 0) | sized, k % 3 == 0, F.when(k % 2 == 0, "hash"), k % 4 == 0)
    return t(spark, sf, "pages").select("page_id", action.alias("action"))


@add("sidecar_sources", """SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'live' WHEN page_id % 2 = 0 THEN 'archive' ELSE 'extract' END AS source,
CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN 'ocr' ELSE 'cached' END WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 7 = 0 THEN 'ocr' ELSE 'cached-archive' END ELSE 'extracted' END AS method FROM pages""")
def sidecar_sources(spark, sf):
    k = F.col("page_id")
    source, method = archive.sidecar_source(F.when(k % 3 != 0, F.col("html")), F.when(k % 2 == 0, F.col("html")), F.when(k % 7 == 0, "ocr"), k % 5 == 0)
    return t(spark, sf, "pages").select("page_id", source.alias("source"), method.alias("method"))


@add("item_set_diff", """WITH a AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE value < 70 GROUP BY ALL), b AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE value > 20 GROUP BY ALL)
SELECT user_id || '-' || event_type AS id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM a FULL JOIN b USING (user_id, event_type) WHERE a.v IS DISTINCT FROM b.v""")
def item_set_diff(spark, sf):
    e = t(spark, sf, "events")
    side = lambda test: e.where(test).groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    named = hashes.identity(F.concat_ws("-", "user_id", "event_type"), F.col("user_id"))
    return diff.item_set_diff(side("value < 70"), side("value > 20"), named, ["event_type", "v"])


@add("hash_known_diff", "SELECT page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0")
def hash_known_diff(spark, sf):
    """A hash that is missing on one side is no change."""
    pages, k = t(spark, sf, "pages"), F.col("page_id")
    before = pages.select("page_id", F.when(k % 4 != 0, F.sha2("html", 256)).alias("sha"))
    after = pages.select("page_id", F.when(k % 5 != 0, F.when(k % 3 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))).alias("sha"))
    return diff.snapshot_diff(before, after, "page_id", ["sha"], if_known=("sha",)).where("change_type = 'changed'").select("page_id")


@add("encoded_urls", r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '?b=2&A=%20x&_=9&b=1' ELSE '?FillWidth=3&q=a/b' END AS q, regexp_extract(url, '^([^:]+)://([^/?#]*)([^?#]*)', ['s', 'h', 'p']) AS m FROM pages)
SELECT page_id, lower(m.s) || '://' || lower(m.h) || '/' || array_to_string(list_filter(string_split(m.p, '/'), lambda x: x <> ''), '/') || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '?A=+x&b=1&b=2' ELSE '?q=a%2Fb' END AS url FROM u WHERE m.s <> ''""")
def encoded_urls(spark, sf):
    query = F.element_at(F.array(F.lit(""), F.lit("?b=2&A=%20x&_=9&b=1"), F.lit("?FillWidth=3&q=a/b")), (F.col("page_id") % 3 + 1).cast("int"))
    raw = F.concat(F.regexp_replace("url", "[?#].*$", ""), query, F.lit("#top"))
    return t(spark, sf, "pages").where(F.col("url").rlike("^[^:]+://")).select("page_id", urls.encoded_canonical_url(raw).alias("url"))
