"""Links, documents and summaries of captured pages: everything that a crawl decides once the pages are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, urls
from tessera.functions.text import classify_meeting, html_lines, html_to_text, html_unescape, normalize_space
from tessera.operators.extract import items

_ANCHOR = r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["'][^>]*>(.*?)</a>"""
#: What a candidate for a document contains.
CANDIDATE = r"(?i)\.pdf|download|document|\.aspx"


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href, label) of all anchors in order."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all(html, F.lit(_ANCHOR), 2).alias("inner"))
    each = pages.select(key, F.posexplode_outer(found).alias("pos", "_a")).where("_a IS NOT NULL")
    return each.select(key, "pos", F.col("_a.href").alias("href"), html_to_text(F.col("_a.inner")).alias("label"))


def index_entries(pages: DataFrame, key: str, html: str, target: str) -> DataFrame:
    """(key, href, title, description) of list items whose link contains ``target``: the description is what the item
    says besides the title."""
    blocks = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)).alias("_b"))
    href, title, whole = F.regexp_extract("_b", _ANCHOR, 1), html_to_text(F.regexp_extract("_b", _ANCHOR, 2)), html_to_text(F.col("_b"))
    rest = normalize_space(F.concat(F.call_function("substring_index", whole, title, F.lit(1)), F.lit(" "), F.substr(whole, F.instr(whole, title) + F.length(title))))
    return blocks.select(key, href.alias("href"), title.alias("title"), F.when(title == "", whole).otherwise(rest).alias("description")).where(F.contains("href", F.lit(target)))


_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attributes(html: Column, tags: str, name: str) -> Column:
    """Values of an attribute of some tags, quoted or not, in order."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tags})\b[^>]*?\s{name}{_VALUE}"), F.lit(1))
    return F.transform(found, lambda x: html_unescape(F.regexp_replace(x, "^[\"']|[\"']$", "")))


def document_candidates(html: Column, base: Column | None = None) -> Column:
    """Targets that look like documents, each once: first those of links, frames and embedded objects, then whatever a quoted
    href, src or data of any tag names, as it is written. With ``base``, the addresses that they lead to from there."""
    every = F.concat(
        _attributes(html, "a|iframe|embed|object", "href"), _attributes(html, "iframe|embed|object", "src"), _attributes(html, "object", "data"),
        F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src|data)=["']([^"']+)["']"""), F.lit(1)),
    )
    if base is not None:
        every = F.transform(every, lambda x: urls.join(base, x))
    return F.filter(F.array_distinct(every), lambda x: x.rlike(CANDIDATE))


def discover(first_pass: DataFrame, second_pass: DataFrame, key: list[str], position: str) -> DataFrame:
    """What either pass finds, the first pass before the second and the first place before later ones."""
    both = first_pass.withColumn("_pass", F.lit(1)).unionByName(second_pass.withColumn("_pass", F.lit(2)))
    rest = [c for c in first_pass.columns if c not in key]
    best = both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_pass", position)).alias("_row"))
    return best.select(*key, "_row.*").select(*first_pass.columns)


def last_by_address(documents: DataFrame, owner: str, url: str, position: str) -> DataFrame:
    """One document per owner and address without its fragment: the last."""
    address = F.regexp_replace(url, "#.*$", "").alias("address")
    rest = [c for c in documents.columns if c != owner]
    best = documents.groupBy(owner, address).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
    return best.select(owner, "address", "_row.*")


def resolve(starts: DataFrame, hops: DataFrame, depth: int = 3) -> DataFrame:
    """(start, at, depth): where each start leads by ``hops`` (page, target), one row per page, in ``depth`` steps at
    most; a page that was visited before ends the walk."""
    every = walk = starts.select("start", F.col("start").alias("at"), F.array("start").alias("_seen"), F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        onward = walk.join(hops, F.col("at") == F.col("page")).where(~F.array_contains("_seen", F.col("target")))
        walk = onward.select("start", F.col("target").alias("at"), F.array_append("_seen", F.col("target")).alias("_seen"), F.lit(step).alias("depth"))
        every = every.unionByName(walk)
    return every.groupBy("start").agg(F.max_by("at", "depth").alias("at"), F.max("depth").alias("depth"))


def source_headers(headers: Column, final_url: Column) -> Column:
    """(etag, modified, length, type, url) of a captured answer's headers, whose names are in any case; null for none."""
    low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    get = lambda name: low[F.lit(name)]
    fields = F.struct(get("etag").alias("etag"), get("last-modified").alias("modified"), F.try_to_number(get("content-length"), F.lit("999999999999")).cast("long").alias("length"), get("content-type").alias("type"), final_url.alias("url"))
    return F.when(headers.isNotNull(), fields)


def summary_links(index: DataFrame, url: str, html: str, years: list[int]) -> DataFrame:
    """(url, first_at) of the summaries that index pages link to, each once.

    The words or the address of a link must say summary, and the address lie below ``summaries/``. A date among the words must be
    of one of the years; without any, or without a date, all are taken. ``first_at`` is the page and the place.
    """
    found = links(index.select(F.col(url).alias("_page"), F.col(html).alias("_html")), "_page", "_html")
    to = urls.join(F.col("_page"), F.col("href"))
    date = dates.parse_date(F.col("label"))
    wanted = F.lower(F.concat_ws(" ", "label", "_to")).contains("summary") & F.col("_to").contains("/summaries/") & (F.regexp_replace("_to", "/+$", "") != F.regexp_replace("_page", "/+$", ""))
    in_years = F.coalesce(F.substring(date, 1, 4).cast("int").isin(years), F.lit(True)) if years else F.lit(True)
    kept = found.withColumn("_to", to).where(wanted & in_years)
    return kept.groupBy(F.col("_to").alias("url")).agg(F.min(F.struct("_page", "pos")).alias("first_at"))


def summaries(pages: DataFrame, url: str, html: str, limit: int = 5000) -> DataFrame:
    """(date, title, url, text, meeting_title, meeting_group, lines) of summary pages.

    The title is the first heading's, else the page's; the date is in the title, else in the text; what a meeting is called and
    its group come from the title without the word Summary. ``text`` has ``limit`` characters, ``lines`` the whole text.
    """
    heading = lambda tag: F.nullif(html_to_text(F.regexp_extract(F.col(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    given = pages.select(F.col(url).alias("url"), html_unescape(F.coalesce(heading("h1"), heading("title"))).alias("title"), html_lines(F.col(html)).alias("lines"))
    body = normalize_space(F.col("lines"))
    name, group = classify_meeting(F.coalesce(F.replace("title", F.lit(" Summary"), F.lit("")), F.lit("Council meeting")))
    date = F.coalesce(dates.parse_date(F.col("title")), dates.parse_date(F.regexp_replace("lines", r"\s+", " ")))
    return given.select(date.alias("date"), "title", "url", F.substring(body, 1, limit).alias("text"), name.alias("meeting_title"), group.alias("meeting_group"), "lines")


def summary_items(read: DataFrame, records: DataFrame, position: str) -> DataFrame:
    """Items of what ``summaries`` has read: of whole texts, under the meeting that each summary names; the key is the address."""
    meetings = read.select("url", "lines", "date", "meeting_title", "meeting_group", F.col("url").alias("meeting_url"), F.col("url").alias("summary_url"), F.lit("Council summary").alias("source_kind"))
    return items(meetings, records, "url", "lines", position)
