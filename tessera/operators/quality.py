"""Data-quality reports: one row (severity, code, value) per check, from one pre-aggregated pass per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.sources import files


def check(code: str, value: Column, failed: Column, severity: str = "warn") -> Column:
    """A check as a struct over aggregates of a table."""
    return F.struct(F.when(F.coalesce(failed, F.lit(False)), severity).otherwise("pass").alias("severity"), F.lit(code).alias("code"), F.round(value.cast("double"), 6).alias("value"))


def check_row(severity: Column | str, code: str, message: Column | str, details: Column | None = None) -> Column:
    """A check as (severity, code, message, details): details are JSON text, or null where there is nothing to tell: null,
    an empty text, list, map or struct list."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    told = F.lit(None).cast("string") if details is None else F.to_json(F.struct(details.alias("d")))
    body = F.regexp_extract(told, r'(?s)^\{"d":(.*)\}$', 1)
    return F.struct(as_column(severity).alias("severity"), F.lit(code).alias("code"), as_column(message).alias("message"), F.when(~body.isin("", "[]", "{}", '""', "null"), body).alias("details"))


def missing_datasets(spark: SparkSession, required: dict[str, str]) -> DataFrame:
    """(severity, code, message, details) of the required datasets (name and path) whose file isn't there or holds no JSON;
    each has a code of its own, ``missing-`` and its name."""
    there = {name: path for name, path in required.items() if files.exists(spark, path)}
    whole = [spark.read.text(path, wholetext=True).select(F.lit(name).alias("name"), F.try_parse_json("value").isNotNull().alias("ok")) for name, path in there.items()]
    shape = "name string, ok boolean"
    readable = combine(*whole) if whole else spark.createDataFrame([], shape)
    named = spark.createDataFrame(list(required.items()), "name string, path string")
    bad = named.join(F.broadcast(readable.groupBy("name").agg(F.bool_and("ok").alias("ok"))), "name", "left").where("NOT coalesce(ok, false)")
    return bad.select(F.lit("fail").alias("severity"), F.concat(F.lit("missing-"), "name").alias("code"), F.concat(F.lit("Missing or invalid "), F.element_at(F.split("path", "/"), -1)).alias("message"), F.lit(None).cast("string").alias("details"))


def report(df: DataFrame, *checks: Column) -> DataFrame:
    """The checks of one table, evaluated in a single aggregate."""
    return df.agg(F.array(*checks).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def duplicates(df: DataFrame, key: str, code: str, severity: str = "warn") -> DataFrame:
    """How many keys occur more than once."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    n = F.count(F.when(F.col("_n") > 1, 1))
    return report(per, check(code, n, n > 0, severity))


def share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("int"))


def failures(code: str, test: Column, all_fail: bool = False) -> Column:
    """Any failing row warns; with ``all_fail``, only failing rows fail."""
    n, of = F.count_if(test), F.count("*")
    severity = F.when((n == of) & (n > 0), "fail").otherwise("warn") if all_fail else F.lit("warn")
    return F.struct(F.when(n > 0, severity).otherwise("pass").alias("severity"), F.lit(code).alias("code"), n.cast("double").alias("value"))


def nothing(code: str, test: Column, severity: str = "warn") -> Column:
    """Rows without a single one that passes the test are worth a warning."""
    n = F.count_if(test)
    return check(code, n, (F.count("*") > 0) & (n == 0), severity)


def ratio(code: str, part: Column, whole: Column, least: float = 0.7) -> Column:
    """The share of the rows of ``whole`` that are in ``part``, warned about below ``least``."""
    share_of = F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0))
    return check(code, share_of, share_of < least)


def at_most(code: str, limit: int) -> Column:
    n = F.count("*")
    return check(code, n, n > limit, "fail")


def same_size(inferred: DataFrame, kept: DataFrame, empty_code: str, code: str) -> DataFrame:
    """A set that was inferred against the one that is kept: kept empty fails, another size warns."""
    both = inferred.agg(F.count("*").alias("_i")).join(F.broadcast(kept.agg(F.count("*").alias("_k"))), F.lit(True))
    empty = (F.col("_i") > 0) & (F.col("_k") == 0)
    severity = F.when(empty, "fail").when(F.col("_i") != F.col("_k"), "warn").otherwise("pass")
    return both.select(severity.alias("severity"), F.when(empty, empty_code).otherwise(code).alias("code"), F.col("_k").cast("double").alias("value"))


def absent(required: list[str], present: DataFrame, key: str) -> DataFrame:
    """The required keys that a listing lacks; ``required`` is a literal table."""
    wanted = present.sparkSession.createDataFrame([(x,) for x in required], f"{key} string")
    there = present.select(key).where(F.col(key).isin(required)).distinct()
    return wanted.join(there, key, "left_anti")


def featured(number: Column, chosen: DataFrame, items: DataFrame, item_number: str) -> DataFrame:
    """The featured record against the collected items: none warns, one without a number fails, one without an item
    warns. ``chosen`` has one row at most."""
    one = chosen.agg(F.count("*").alias("_n"), F.max(number).alias("_number"))
    hit = items.join(F.broadcast(one), F.col(item_number).cast("string") == F.col("_number"), "left_semi").agg((F.count("*") > 0).alias("_hit"))
    both = one.join(F.broadcast(hit), F.lit(True))
    none, empty = F.col("_n") == 0, F.coalesce("_number", F.lit("")) == ""
    severity = F.when(none, "warn").when(empty, "fail").when(~F.col("_hit"), "warn").otherwise("pass")
    code = F.when(none, "featured-missing").when(empty, "featured-number").otherwise("featured-source-match")
    return both.select(severity.alias("severity"), code.alias("code"), F.col("_n").cast("double").alias("value"))


def details(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """(values, n_values): the first ``n`` distinct values in order, and how many there are."""
    shown = df.select(value).distinct().orderBy(value).limit(n).agg(F.array_sort(F.collect_list(value)).alias("values"))
    return shown.join(F.broadcast(df.agg(F.countDistinct(value).alias("n_values"))), F.lit(True))


def unknown(df: DataFrame, column: str, known: list[str], shown: int = 100) -> DataFrame:
    """(n, labels): how many distinct labels are outside of the known ones, and the first ``shown`` of them in order."""
    other = df.select(column).where(~F.col(column).isin(known)).distinct()
    first = other.orderBy(column).limit(shown).agg(F.array_sort(F.collect_list(column)).alias("labels"))
    return other.agg(F.count("*").alias("n")).join(F.broadcast(first), F.lit(True))


def health(datasets: DataFrame) -> DataFrame:
    """(n_available, n_missing, status) of a table of datasets (name, n, required)."""
    there, missing = F.count_if(F.col("n") > 0), F.count_if((F.col("n") == 0) & F.col("required"))
    status = F.when(missing > 0, "Attention").when(there < F.count("*"), "Partial").otherwise("Healthy")
    return datasets.agg(there.alias("n_available"), missing.alias("n_missing"), status.alias("status"))


def header_lint(pages: DataFrame, path: str, html: str, placeholder: str, script: str, root: Column, expected: Column, hard_coded: str | None = None, within: bool = False) -> DataFrame:
    """(path, errors): pages whose shared header isn't one placeholder for the site's root and, after it, one script of
    the expected address, or that hold the text ``hard_coded`` of a header of their own. ``placeholder`` and ``script``
    are patterns; group 1 is the root or the address, or with ``within`` a text that the root must stand in."""
    every = lambda p, g: F.regexp_extract_all(html, F.lit(p), g)
    own = F.contains(html, F.lit(hard_coded)) if hard_coded else F.lit(False)
    df = pages.select(F.col(path), own.alias("_own"), F.size(every(placeholder, 0)).alias("_p"), F.size(every(script, 0)).alias("_s"), F.get(every(placeholder, 1), F.lit(0)).alias("_root"), F.get(every(script, 1), F.lit(0)).alias("_src"), F.expr(f"instr(`{html}`, regexp_extract(`{html}`, '{_quoted(placeholder)}', 0))").alias("_at"), F.expr(f"instr(`{html}`, regexp_extract(`{html}`, '{_quoted(script)}', 0))").alias("_after"), root.alias("_want"), expected.alias("_wanted"))
    errors = F.array_compact(F.array(
        F.when(F.col("_p") != 1, "placeholders").otherwise(F.when(~F.contains("_root", F.col("_want")) if within else F.col("_root") != F.col("_want"), "root")),
        F.when(F.col("_s") != 1, "scripts").otherwise(F.when(F.col("_src") != F.col("_wanted"), "address")),
        F.when((F.col("_p") > 0) & (F.col("_s") > 0) & (F.col("_at") > F.col("_after")), "order"),
        F.when(F.col("_own"), "hard-coded"),
    ))
    return df.select(path, F.array_join(errors, ",").alias("errors")).where("errors <> ''")


# The shared header's placeholder and script.
HEADER_PLACEHOLDER = r'(?i)<div\s+([^>]*data-shared-header[^>]*)></div>'
HEADER_SCRIPT = r'(?i)<script\b[^>]*src="([^"]*shared-header\.min\.js\?v=[^"]+)"[^>]*></script>'


def shared_header_lint(pages: DataFrame, path: str, html: str, version: str) -> DataFrame:
    """``header_lint`` for the shared header of this version: the script lies at the site's root."""
    root = urls.expected_root(F.col(path))
    address = F.concat(F.when(root == "..", "../").otherwise(""), F.lit(f"shared-header.min.js?v={version}"))
    attribute = F.concat(F.lit('data-root="'), root, F.lit('"'))
    return header_lint(pages, path, html, HEADER_PLACEHOLDER, HEADER_SCRIPT, attribute, address, '<header class="site-header', within=True)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def combine(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def overall(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Counts by severity and the overall status: fail over warn over pass; strict turns warn into fail."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    status = F.when(count("fail") > 0, "fail").when(count("warn") > 0, "fail" if strict else "warn").otherwise("pass")
    return checks.agg(count("fail").alias("n_fail"), count("warn").alias("n_warn"), count("pass").alias("n_pass"), status.alias("status"))
