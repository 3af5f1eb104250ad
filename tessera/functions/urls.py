"""URL and path functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, single slashes, no trailing one, no fragment; query items sorted, without
    ``fillwidth`` and ``_``."""
    part = lambda i: F.regexp_extract(c, _PARTS, i)
    path = F.regexp_replace(F.regexp_replace(part(3), "/{2,}", "/"), "/+$", "")
    items = F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~F.lower(x).startswith("fillwidth=") & ~F.lower(x).startswith("_="))
    # sorted by the lower-cased item
    query = F.array_join(F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x.v), "&")
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(url)


def valid_url(c: Column) -> Column:
    """Whether it has the scheme http or https, in any case, and a host."""
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def encoded_canonical_url(c: Column) -> Column:
    """The archive's form: lower-case scheme and host, no empty path steps, no fragment; query items are decoded,
    sorted by the lower-cased name and the value, and encoded anew, without ``fillwidth`` and ``_``."""
    part = lambda i: F.regexp_extract(c, _PARTS, i)
    pair = lambda x: F.struct(F.lower(_decoded(F.regexp_extract(x, "^([^=]*)", 1))).alias("k"), _decoded(F.regexp_extract(x, "^[^=]*=?(.*)$", 1)).alias("v"), _decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("name"))
    items = F.filter(F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), pair), lambda x: ~x["k"].isin("fillwidth", "_"))
    # an asterisk is left alone by one encoder and a tilde by the other
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(encoded(x["name"]), F.lit("="), encoded(x["v"]))), "&")
    path = F.concat(F.lit("/"), F.array_join(F.filter(F.split(part(3), "/"), lambda x: x != ""), "/"))
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(url)


def is_remote(c: Column) -> Column:
    return F.coalesce(F.lower(c).startswith("http://") | F.lower(c).startswith("https://"), F.lit(False))


def safe_external_url(c: Column) -> Column:
    """An http or https URL as it is, else empty."""
    return F.when(valid_url(F.trim(c)), F.trim(c)).otherwise("")


def safe_url(c: Column, allowed: tuple[str, ...]) -> Column:
    """An external URL, or a safe relative path that begins with one of ``allowed``; else empty."""
    path = normalize_local(c)
    inside = path.rlike("^(?:" + "|".join(x.replace(".", "[.]") for x in allowed) + ")")
    return F.when(is_remote(F.trim(c)), safe_external_url(c)).when(inside, path).otherwise("")


def viewer_url(path: Column, title: Column, context: Column, number: Column) -> Column:
    """The viewer's address of an archived PDF with its query, or empty."""
    local = local_pdf(path)
    given = lambda x, other: F.when(F.coalesce(x, F.lit("")) == "", other).otherwise(x)
    query = [F.lit("pdf.html?file="), F.url_encode(local), F.lit("&title="), F.url_encode(given(title, "Archived document")), F.lit("&context="), F.url_encode(given(context, "Archived source document"))]
    tail = F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(F.concat(F.lit("&number="), F.url_encode(number)))
    return F.when(local == "", "").otherwise(F.concat(*query, tail))


def primary_url(detail: Column, viewer: Column, source: Column, meeting: Column) -> Column:
    """The first that there is: the detail page, the viewer, the source document, the meeting; else ``#``."""
    some = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    return F.coalesce(some(safe_url(detail, ("bylaws/detail.html",))), some(viewer), some(safe_external_url(source)), some(safe_external_url(meeting)), F.lit("#"))


def committee_pdf(c: Column) -> Column:
    """The path of a local PDF without its query, or empty: no scheme, no parent steps after the first."""
    path = F.replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\.\./", ""), F.lit("\\"), F.lit("/"))
    bad = is_remote(path) | path.contains("..") | ~path.rlike(r"(?i)\.pdf(?:$|[?#])")
    return F.when(bad, "").otherwise(F.regexp_replace(path, "[?#].*$", ""))


# Kinds of meetings, and what their links contain.
MEETING_KINDS = "regular council|special council|public hearing|governance and priorities|finance and audit|public safety committee|advisory committee|committee|board|commission|panel|task force|working group"
MEETING_TOKENS = "meeting|agenda|id="


def is_meeting_link(label: Column, context: Column, href: Column) -> Column:
    """Whether the words around a link name a kind of meeting and its target looks like one."""
    words = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(context, F.lit(""))))
    return words.rlike(MEETING_KINDS) & F.coalesce(F.lower(href).rlike(MEETING_TOKENS), F.lit(False))


# What is published, and what of it isn't.
PUBLISHED = "data/|archive/|bylaws/pdf/|council/"
PUBLIC_KEYS = ("collection-status.json", "archive-manifest.json")
EXCLUDED_NAMES = ("index.html", "list.js", "detail.html", "detail.js", "web.config", ".gitkeep", "desktop.ini", "thumbs.db")
EXCLUDED_SUFFIXES = (".pyc", ".tmp", ".log", ".db", ".sqlite", ".sqlite3")


def is_publishable(c: Column) -> Column:
    """Whether a file of the site goes to the store: below a published folder, not directly in ``council/``, and
    neither of an excluded name nor suffix. A name that only begins with a dot has no suffix."""
    name = F.lower(F.regexp_extract(c, "([^/]*)$", 1))
    excluded = name.isin(*EXCLUDED_NAMES) | name.rlike("[^.].*(?:" + "|".join(x.replace(".", "[.]") for x in EXCLUDED_SUFFIXES) + ")$|^[^.](?:" + "|".join(x.replace(".", "[.]") for x in EXCLUDED_SUFFIXES) + ")$")
    return F.coalesce(c.rlike(f"^(?:{PUBLISHED})") & ~c.rlike("^council/[^/]*$") & ~excluded, F.lit(False))


def is_allowed_key(c: Column) -> Column:
    """Whether the store hands out a key: not a folder, no parent steps or control characters, a public key or below
    a published folder."""
    safe = (c != "") & ~c.endswith("/") & ~c.contains("..") & ~c.rlike("[\x01-\x1f]")
    return F.coalesce(safe & (c.isin(*PUBLIC_KEYS) | c.rlike(f"^(?:{PUBLISHED}|text/)")), F.lit(False))


def is_pdf(content: Column) -> Column:
    """Whether the content, after blanks, begins as a PDF does."""
    return F.coalesce(F.ltrim(content).startswith("%PDF-"), F.lit(False))


def is_authored_page(c: Column, excluded: tuple[str, ...]) -> Column:
    """Whether a page is outside of the excluded folders and isn't one of them."""
    return ~c.rlike("^(?:" + "|".join(x.replace(".", "[.]") for x in excluded) + ")(?:/|$)")


def expected_root(c: Column) -> Column:
    """How a page names the site's root: ``..`` from a folder, ``.`` at the top."""
    return F.when(c.contains("/"), "..").otherwise(".")


def absolute_url(site: str, c: Column, fallback: str) -> Column:
    raw = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    raw = F.when(raw == "", fallback).otherwise(raw)
    return F.when(F.lower(raw).rlike("^https?://"), raw).otherwise(F.concat(F.lit(site.rstrip("/") + "/"), F.regexp_replace(raw, "^/+", "")))


def normalize_local(c: Column) -> Column:
    """A safe relative path, or empty: no scheme, no parent steps, no control characters."""
    raw = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(raw, r"^\./", ""), r"^(?:\.\./)+", "")
    bad = (raw == "") | raw.startswith("//") | raw.rlike("[\x01-\x1f]") | (path == "") | path.rlike(r"^[^?#]*(?:^|/)\.\.(?:/|[?#]|$)") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(bad, "").otherwise(path)


# Folders that hold archived files.
PDF_FOLDERS = "archive/|bylaws/pdf/|council/"


def local_pdf(c: Column) -> Column:
    path = normalize_local(c)
    plain = F.regexp_replace(path, "[?#].*$", "")
    return F.when(path.rlike(r"(?i)\.pdf(?:$|[?#])") & ~path.rlike(r"(?i)\.(?:ashx|aspx)(?:$|[?#])") & plain.rlike(f"^(?:{PDF_FOLDERS})"), plain).otherwise("")


# Media types by suffix.
MEDIA_TYPES = {
    ".pdf": "application/pdf", ".json": "application/json", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".js": "text/javascript", ".csv": "text/csv", ".xml": "text/xml", ".svg": "image/svg+xml",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".zip": "application/zip",
}


def content_type(c: Column) -> Column:
    """The media type by suffix, of bytes where it tells nothing."""
    suffix = F.lower(F.regexp_extract(c, "[^/]([.][^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])[suffix], F.lit("application/octet-stream"))


# How long stored files and answers of the store may be kept.
def cache_control(c: Column) -> Column:
    """Of a stored file: data are short-lived, PDFs and texts live an hour, all else five minutes."""
    return F.when(c.startswith("data/"), "public, max-age=60, must-revalidate").when(F.lower(c).rlike("[^/][.](?:pdf|txt)$"), "public, max-age=3600").otherwise("public, max-age=300, must-revalidate")


def answer_cache_control(c: Column) -> Column:
    """Of an answer for a key: caches in between may keep it longer than browsers."""
    return (
        F.when(c == "collection-status.json", "public, max-age=30, s-maxage=60, must-revalidate").when(c.startswith("data/"), "public, max-age=60, s-maxage=300, must-revalidate")
        .when(c.rlike("(?i)[.](?:pdf|txt)$"), "public, max-age=3600, s-maxage=86400").otherwise("public, max-age=300, s-maxage=900, must-revalidate")
    )


def _steps(path: Column) -> Column:
    """A path without its dot steps."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, x)))
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def join(base: Column, c: Column) -> Column:
    """The address that a link leads to from a page: absolute ones as they are, others from the page's scheme, host, folder or
    path."""
    part = lambda i: F.regexp_extract(base, _PARTS, i)
    link = F.trim(F.coalesce(c, F.lit("")))
    origin, path = F.concat(part(1), F.lit("://"), part(2)), part(3)
    own, tail = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(part(1), F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, _steps(own), tail))
        .when(link == "", F.regexp_replace(base, "#.*$", "")).when(link.startswith("?"), F.concat(origin, path, tail)).when(link.startswith("#"), F.concat(origin, path, query, tail)).otherwise(F.concat(origin, _steps(F.concat(folder, own)), tail))
    )


def status_class(status: Column) -> Column:
    """The style of a status label."""
    return F.concat(F.lit("status-"), F.lower(F.regexp_replace(status, "[^A-Za-z0-9]+", "-")))


def byte_label(c: Column) -> Column:
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(F.round(c / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(c / 1048576, 1).cast("string"), F.lit(" MB")))


def document_path(date: Column, meeting: Column, name: Column, root: str = "council/pdf") -> Column:
    return F.concat_ws("/", F.lit(root), F.coalesce(date, F.lit("undated")), meeting, F.concat(name, F.lit(".pdf")))


# What makes a link a public record, and what rules one out.
BLOCKED_PAGES = "sharing.aspx|meeting.aspx|delegationrequest.aspx|login.aspx|register.aspx|calendar.aspx"
BLOCKED_WORDS = "meetingview|delegation request|share this meeting|calendar|video|youtube|webcast|subscribe"
RECORD_WORDS = "agenda|minutes|minute|notice|report|attachment|package|document|supplemental|revised"


def is_document_link(label: Column, href: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    name = F.lower(F.regexp_extract(F.regexp_replace(href, "[?#].*$", ""), "([^/]*)$", 1))
    both = F.concat_ws(" ", low, F.lower(href))
    useful = low.rlike(RECORD_WORDS) | name.rlike(r"\.(?:pdf|ashx)$|document|attachment") | both.contains("download")
    return ~name.rlike(f"^(?:{BLOCKED_PAGES})$") & ~both.rlike(BLOCKED_WORDS) & useful


def hrefs(html: Column) -> Column:
    """Distinct link targets of a page in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:href|src|data)="([^"]*)\""""), 1))
