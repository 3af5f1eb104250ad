"""Content-addressed archives: manifests, hash-skipping upserts, stored names, remote validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import alnum_count, first_truthy


def manifest(files: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """n, total bytes, distinct contents and duplicates in one aggregate."""
    n, distinct = F.count("*"), F.countDistinct(digest)
    return files.agg(n.alias("n"), F.sum(size).alias("total_bytes"), distinct.alias("n_distinct"), (n - distinct).alias("n_duplicates"))


def upsert_plan(local: DataFrame, remote: DataFrame, key: str, digest: str) -> DataFrame:
    """What to write: key, and upload where the remote copy is absent or differs, else skip."""
    there = remote.select(key, F.col(digest).alias("_there"))
    action = F.when(F.col("_there").isNull(), "upload-new").when(F.col("_there") != F.col(digest), "upload-changed").otherwise("skip")
    return local.join(there, key, "left").select(key, action.alias("action"))


def stored_name(stem: Column, suffix: str, digest: Column, taken: Column) -> Column:
    """The plain name, or one with ten digits of the hash where another content has it."""
    return F.when(taken, F.concat(stem, F.lit("-"), F.substring(digest, 1, 10), F.lit(suffix))).otherwise(F.concat(stem, F.lit(suffix)))


def remote_changed(before: str, after: str) -> Column:
    """Whether validators prove a change; absent ones never do. ``before``/``after`` are structs with url, etag,
    modified, length."""
    def differ(f):
        a, b = F.col(f"{before}.{f}").cast("string"), F.col(f"{after}.{f}").cast("string")
        return F.coalesce((a != "") & (b != "") & (F.trim(a) != F.trim(b)), F.lit(False))

    return differ("url") | differ("etag") | differ("modified") | differ("length")


def overlay(base: DataFrame, over: DataFrame, key: str, present: str) -> DataFrame:
    """Records of ``base`` with the fields that ``over`` has, even where they are null there.

    ``present`` is a column of ``over``: an array of the names of the fields that the record has.
    """
    fields = [c for c in over.columns if c not in (key, present)]
    other = over.select(key, F.col(present).alias("_present"), *[F.col(c).alias(f"_over_{c}") for c in fields])
    joined = base.join(other, key, "left")
    has = lambda c: F.coalesce(F.array_contains("_present", c), F.lit(False))
    return joined.select(*[F.when(has(c), F.col(f"_over_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def length_changed(before: Column, after: Column, content_type: Column, local_size: Column) -> Column:
    """Whether lengths prove a change: two recorded ones that differ, or for a PDF without a recorded one, the local
    file's size and the new length."""
    recorded, now = F.try_to_number(before, F.lit("9999999999")), F.try_to_number(after, F.lit("9999999999"))
    unrecorded = F.coalesce(before, F.lit("")) == ""
    pdf = F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf")
    return F.coalesce(~unrecorded & (recorded != now), F.lit(False)) | F.coalesce(unrecorded & pdf & (local_size != now), F.lit(False))


def reuse_action(exists: Column, changed: Column, stored_anew: Column, previous_hash: Column, canonical: Column) -> Column:
    """What to do for a document: reuse the archived copy unless there is none or its source has changed.

    ``stored_anew`` says whether the content is new to the archive, ``canonical`` whether the copy is in its place.
    """
    download = ~exists | changed
    known = F.coalesce(previous_hash, F.lit("")) != ""
    fetched = F.when(~stored_anew, "downloaded-deduplicated").when(known, "downloaded-changed").otherwise("downloaded-new")
    return F.when(download, fetched).when(canonical, "reused").when(stored_anew, "archive-repaired").otherwise("reused")


def sidecar_source(live: Column, archived: Column, previous_method: Column, force: Column) -> tuple[Column, Column]:
    """(where a document's text comes from, method): the live sidecar unless the content has changed, the archive's,
    else a new extraction."""
    source = F.when(~force & live.isNotNull(), "live").when(archived.isNotNull(), "archive").otherwise("extract")
    method = F.when(source == "extract", "extracted").otherwise(first_truthy(previous_method, F.when(source == "live", "cached").otherwise("cached-archive")))
    return source, method


def page_extraction(pages: DataFrame, document: str, least: int = 80) -> DataFrame:
    """How documents' texts were extracted, from a row per page (document, page, text, ocr_text).

    A page with fewer than ``least`` letters and digits is sparse; its recognised text is taken if it has more.
    """
    count = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    sparse = count(F.col("text")) < least
    ocr = sparse & (count(F.col("ocr_text")) > count(F.col("text")))
    chosen = pages.select(document, sparse.alias("sparse"), ocr.alias("ocr"), F.length(F.trim(F.when(ocr, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit(""))))).alias("n"))
    per = chosen.groupBy(document).agg(F.count("*").alias("n_pages"), F.count_if("sparse").alias("n_sparse"), F.count_if("ocr").alias("n_ocr"), F.sum("n").alias("_n"))
    method = F.when((F.col("n_ocr") > 0) & (F.col("n_ocr") == F.col("n_pages")), "ocr").when(F.col("n_ocr") > 0, "hybrid").when(F.col("_n") > 0, "embedded").otherwise("none")
    return per.select(document, "n_pages", "n_sparse", "n_ocr", method.alias("method"))


def page_texts(pages: DataFrame, document: str, least: int = 80, max_pages: int = 300, max_ocr_pages: int = 12, max_characters: int = 2_000_000) -> DataFrame:
    """(document, text, page_count, method, ocr_pages, sparse_pages, character_count, warnings) of documents from a row per page
    (document, page, text, ocr_text; pages count from 1).

    Only the first ``max_pages`` pages are read. Of those with fewer than ``least`` letters and digits the first
    ``max_ocr_pages`` take their recognised text if it has more. Pages that aren't blank are joined in order under a
    marker, up to ``max_characters``: a running length tells what fits, so no more than that is gathered.
    """
    stripped = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    by_page = Window.partitionBy(document).orderBy("page")
    sparse = alnum_count(F.col("text")) < least
    read = pages.where(F.col("page") <= max_pages).select(document, "page", "text", "ocr_text", sparse.alias("_sparse"))
    tried = F.col("_sparse") & (F.sum(F.col("_sparse").cast("int")).over(by_page) <= max_ocr_pages)
    ocr = tried & (alnum_count(F.col("ocr_text")) > alnum_count(F.col("text")))
    chosen = read.withColumn("_ocr", ocr).withColumn("_body", stripped(F.when(F.col("_ocr"), F.col("ocr_text")).otherwise(F.col("text"))))
    piece = F.when(F.col("_body") != "", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("_body")))
    # with the separator; the first piece has one too many
    placed = chosen.withColumn("_piece", piece).withColumn("_end", F.sum(F.coalesce(F.length("_piece") + 2, F.lit(0))).over(by_page) - 2)
    start = F.col("_end") - F.length("_piece")
    # a page that begins just behind the end still leaves its separator before it
    fitting = F.when(start < max_characters + 2, F.substr(F.col("_piece"), F.lit(1), F.greatest(F.lit(max_characters) - start, F.lit(0)).cast("int")))
    numbers = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("page"))))
    per = placed.withColumn("_piece", fitting).groupBy(document).agg(
        F.expr("listagg(_piece, '\n\n') WITHIN GROUP (ORDER BY page)").alias("text"), F.count("*").alias("page_count"), F.max("_end").alias("_whole"), numbers("_ocr").alias("ocr_pages"), numbers("_sparse").alias("sparse_pages"),
    )
    all_pages = pages.groupBy(document).agg(F.count("*").alias("_all"))
    out = per.join(all_pages, document).withColumn("text", F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(max_characters)))
    n, n_sparse = F.size("ocr_pages"), F.size("sparse_pages")
    method = F.when((n > 0) & (n == F.col("page_count")), "ocr").when(n > 0, "hybrid").when(F.col("text") != "", "embedded").otherwise("none")
    said = lambda test, *parts: F.when(test, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    warnings = F.array_compact(F.array(
        said(F.col("_all") > max_pages, f"Embedded extraction limited to {max_pages} of ", F.col("_all").cast("string"), " pages"),
        said(n_sparse > max_ocr_pages, f"OCR limited to {max_ocr_pages} of ", n_sparse.cast("string"), " sparse pages"),
        said(F.col("_whole") > max_characters, f"Extracted text limited to {max_characters} characters"),
    ))
    return out.select(document, "text", "page_count", method.alias("method"), "ocr_pages", "sparse_pages", F.length("text").alias("character_count"), warnings.alias("warnings"))


def copy_plan(source: DataFrame, there: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """(key, action): copy what is missing, and what differs in size or content; sizes are compared before hashes."""
    other = there.select(key, F.col(size).alias("_size"), F.col(digest).alias("_digest"))
    same = (F.col(size) == F.col("_size")) & (F.col(digest) == F.col("_digest"))
    action = F.when(F.col("_digest").isNull(), "copy-missing").when(same, "skip").otherwise("copy-changed")
    return source.join(other, key, "left").select(key, action.alias("action"))


def rewrite_paths(records: DataFrame, columns: list[str], moved: DataFrame) -> DataFrame:
    """Records whose paths are replaced by those that ``moved`` (duplicate, survivor) names, with n_changed; a path with
    backslashes is also looked up with slashes."""
    out, changed = records, F.lit(0)
    for c in columns:
        found = moved.select(F.col("duplicate").alias(f"_d_{c}"), F.col("survivor").alias(f"_s_{c}"))
        out = out.join(found, F.replace(c, F.lit("\\"), F.lit("/")) == F.col(f"_d_{c}"), "left")
        changed = changed + F.when(F.col(f"_s_{c}").isNotNull(), 1).otherwise(0)
    return out.select(*[F.coalesce(f"_s_{c}", c).alias(c) if c in columns else F.col(c) for c in records.columns], changed.alias("n_changed"))


def file_set(*listings: DataFrame, key: str) -> DataFrame:
    """The distinct keys of several listings, in order."""
    every = listings[0].select(key)
    for more in listings[1:]:
        every = every.unionByName(more.select(key))
    return every.distinct().orderBy(key)


def carry_forward(new: DataFrame, previous: DataFrame, key: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Fields with one of the prefixes are taken from the previous record where the new one lacks them: null, or
    empty."""
    carried = [c for c in previous.columns if c != key and c.startswith(prefixes)]
    old = previous.select(key, *[F.col(c).alias(f"_old_{c}") for c in carried])
    joined = new.join(old, key, "left")
    return joined.select(*[first_truthy(c, f"_old_{c}").alias(c) if c in carried else F.col(c) for c in new.columns])


def choose_candidate(candidates: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """The existing candidate of least priority per key."""
    return candidates.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, priority).alias(value))


def fallback(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """``preferred`` where it has any row, else ``other``; both have the same columns."""
    none = preferred.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(1).alias("_empty"))
    return preferred.unionByName(other.join(F.broadcast(none), F.lit(True)).drop("_empty"))
