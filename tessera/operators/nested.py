"""Rewriting values wherever they stand in nested records: JSON text of any shape, and typed columns of any depth.

In both cases the values of all records are looked up by one join, so the table of replacements, or of files, may be of
any size; a record gets back only what concerns it, and is rebuilt in place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import urls

#: A string of JSON, with the colon that makes it a name; possessive, so strings of any length are matched in a loop.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'


def _value(literal: Column) -> Column:
    """The text that a JSON string stands for."""
    return F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]


def _literal(value: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def replace_values(records: DataFrame, key: str, payload: str, moved: DataFrame) -> DataFrame:
    """Records whose JSON text ``payload`` has each string value that ``moved`` (duplicate, survivor) names replaced, at any
    depth, with n_changed.

    A value that isn't named is looked up once more with slashes for its backslashes. Names of members are left alone, as is
    all between the strings, so texts of any shape and nesting keep their layout. Keys must be unique.
    """
    strings = F.regexp_extract_all(payload, F.lit(_STRING), F.lit(0))
    is_value = lambda x: ~x.endswith(":")
    found = records.select(key, F.explode(F.array_distinct(F.filter(strings, is_value))).alias("_literal")).withColumn("_v", _value(F.col("_literal")))
    named = _named(found, key, moved)
    changes = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_literal", _literal(F.col("_to"))))).alias("_changes"))
    joined = records.join(changes, key, "left").withColumn("_strings", F.when(F.col("_changes").isNotNull(), strings))
    hit = lambda x: F.when(is_value(x), F.element_at("_changes", x))
    gaps = F.split(payload, _STRING, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, "_strings", lambda gap, x: F.array(gap, F.coalesce(hit(x), x, F.lit(""))))), "")
    n = F.size(F.filter("_strings", lambda x: hit(x).isNotNull()))
    out = joined.withColumns({payload: F.when(F.col("_changes").isNull(), F.col(payload)).otherwise(rebuilt), "n_changed": F.when(F.col("_changes").isNull(), 0).otherwise(n)})
    return out.select(*records.columns, "n_changed")


#: A value is common with more than this part of all values (so there are at most as many as its inverse); tasks it is dealt to.
COMMON, DEALT = 1e-4, 64


def _named(found: DataFrame, key: str, moved: DataFrame) -> DataFrame:
    """The rows of ``found`` (key, _literal, _v) whose value ``moved`` names another one for, with that as _to.

    Every distinct value is looked up once. Common values that aren't named never leave their task, and those that are
    named are dealt to several tasks, so that what records share doesn't meet in one.
    """
    values = found.where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
    slashed = F.replace("_v", F.lit("\\"), F.lit("/"))
    ways = F.array_compact(F.array(F.struct(F.lit(0).alias("way"), F.col("_v").alias("as")), F.when(F.contains("_v", F.lit("\\")), F.struct(F.lit(1).alias("way"), slashed.alias("as")))))
    once = moved.groupBy("duplicate").agg(F.max("survivor").alias("survivor")).where("survivor IS NOT NULL")
    tried = values.select("_v", "_n", F.explode(ways).alias("_w")).join(once, F.col("_w.as") == F.col("duplicate"))
    to = tried.groupBy("_v", "_n").agg(F.min_by("survivor", "_w.way").alias("_to")).where("_to <> _v")
    total = values.agg(F.sum("_n").alias("_total"))
    common = lambda df: df.join(F.broadcast(total), F.lit(True)).withColumn("_common", F.col("_n") > F.col("_total") * COMMON).drop("_total", "_n")
    parts = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))
    dealt = common(to).select("_v", "_to", "_common", F.explode(parts).alias("_part"))
    known = common(values).where("_common").select("_v").join(dealt.where("_part = 0 AND _common").select("_v", F.lit(True).alias("_moves")), "_v", "left")
    rows = found.join(F.broadcast(known.select("_v", F.coalesce("_moves", F.lit(False)).alias("_moves"))), "_v", "left").where("coalesce(_moves, true)")
    rows = rows.withColumn("_part", F.when(F.col("_moves").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(DEALT)).cast("int")))
    return rows.join(dealt, ["_v", "_part"]).select(key, "_literal", "_v", "_to")


def structs(c: Column, kind: T.DataType, each: Callable[[Column, T.StructType], Column]) -> Column:
    """The lists that ``each`` makes of all structs within a column of any nesting, joined into one, outer before inner."""
    if isinstance(kind, T.StructType):
        inner = [structs(c[f.name], f.dataType, each) for f in kind.fields if _holds_struct(f.dataType)]
        return F.coalesce(F.concat(each(c, kind), *inner), each(F.lit(None).cast(kind), kind))
    values = F.map_values(c) if isinstance(kind, T.MapType) else c
    element = kind.valueType if isinstance(kind, T.MapType) else kind.elementType
    return F.flatten(F.transform(F.coalesce(values, F.array().cast(T.ArrayType(element))), lambda x: structs(x, element, each)))


def rewrite(c: Column, kind: T.DataType, each: Callable[[Column, T.StructType], dict[str, Column]]) -> Column:
    """The column with the fields of all its structs replaced by what ``each`` returns for them by name."""
    if not _holds_struct(kind):
        return c
    if isinstance(kind, T.StructType):
        new = each(c, kind)
        fields = [(new[f.name] if f.name in new else rewrite(c[f.name], f.dataType, each)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: rewrite(v, kind.valueType, each))
    return F.transform(c, lambda x: rewrite(x, kind.elementType, each))


def _holds_struct(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_struct(kind.elementType)
    return _holds_struct(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StructType)


# The fields that hold links to files, those that a link falls back to, and suffixes of files by an older name.
LOCAL_FIELDS = ("local_path", "archive_path", "local_document")
LINK_FIELD, FALLBACKS = "url", ("source_document_url", "meeting_url")
OLD_SUFFIXES = (".ashx", ".aspx")


def _is_local(value: Column) -> Column:
    return (F.trim(F.coalesce(value, F.lit(""))) != "") & ~urls.is_remote(value)


def _normalized(value: Column) -> Column:
    return F.ltrim(F.replace(value, F.lit("\\"), F.lit("/")), F.lit("/"))


def _is_old(path: Column) -> Column:
    has = lambda x: F.lower(path).endswith(x) & ~path.substr(-len(x) - 1, 1).isin("/", "")
    return reduce(or_, map(has, OLD_SUFFIXES))


def _target(path: Column) -> Column:
    """The PDF that stands for a path with an old suffix."""
    stem = lambda x: F.left(path, F.length(path) - len(x))
    return F.concat(F.coalesce(*[F.when(F.lower(path).endswith(x), stem(x)) for x in OLD_SUFFIXES]), F.lit(".pdf"))


def repair_links(records: DataFrame, key: str, payload: str, there: DataFrame) -> DataFrame:
    """Records whose links to files are repaired in every struct of ``payload``, with n_updated and n_missing.

    ``there`` (path, is_pdf) lists the files. A local link is written with slashes and without a leading one. One with an old
    suffix leads to the PDF of the same name if that is there, or if an old file of that name that any record links to is a PDF
    itself, which then moves; otherwise it is cleared, and a ``url`` falls back to the source, the meeting or ``#``. Keys must be unique.
    """
    kind = records.schema[payload].dataType
    links = lambda shape: [f.name for f in shape.fields if f.name in (*LOCAL_FIELDS, LINK_FIELD) and isinstance(f.dataType, T.StringType)]
    old = lambda v: _is_local(v) & _is_old(_normalized(v))
    none = F.array().cast("array<string>")
    # null for structs that are missing, so that they count for nothing
    listed = lambda c, shape: F.array_compact(F.array(*[F.when(old(c[f]), _normalized(c[f])) for f in links(shape)])) if links(shape) else none
    wanted = records.select(key, F.explode(F.array_distinct(structs(F.col(payload), kind, listed))).alias("_path"))
    wanted = wanted.withColumn("_target", _target(F.col("_path")))
    files = there.groupBy("path").agg(F.bool_or("is_pdf").alias("is_pdf"))
    moving = wanted.select("_path", "_target").distinct().join(files.where("is_pdf").select(F.col("path").alias("_path")), "_path").select("_target")
    usable = files.select(F.col("path").alias("_target")).unionByName(moving).distinct()
    known = wanted.join(usable, "_target").groupBy(key).agg(F.collect_set("_path").alias("_there"))
    joined = records.join(known, key, "left").withColumn("_there", F.coalesce("_there", none))
    # every value is normalized once
    given = lambda v, then: F.transform(F.array(_normalized(v)), then)[0]
    gone = lambda n: _is_old(n) & ~F.array_contains("_there", n)
    missing = lambda v: _is_local(v) & given(v, gone)
    fixed = lambda v: F.when(~_is_local(v), v).otherwise(given(v, lambda n: F.when(gone(n), None).when(_is_old(n), _target(n)).otherwise(n)))

    def repaired(c: Column, shape: T.StructType) -> dict[str, Column]:
        new = {f: fixed(c[f]) for f in links(shape)}
        if LINK_FIELD in new:
            others = [F.nullif(c[f], F.lit("")) for f in FALLBACKS if f in shape.fieldNames()]
            new[LINK_FIELD] = F.when(missing(c[LINK_FIELD]), F.coalesce(*others, F.lit("#"))).otherwise(new[LINK_FIELD])
        return new

    changed = lambda v: _is_local(v) & given(v, lambda n: _is_old(n) | (n != v))
    flag = lambda v: F.struct(F.coalesce(changed(v), F.lit(False)).alias("changed"), F.coalesce(missing(v), F.lit(False)).alias("missing"))
    flags = lambda c, shape: F.array(*[flag(c[f]) for f in links(shape)]).cast("array<struct<changed:boolean,missing:boolean>>")
    count = lambda name: F.size(F.filter("_flags", lambda x: x[name]))
    counted = joined.withColumn("_flags", structs(F.col(payload), kind, flags)).withColumns({"n_updated": count("changed"), "n_missing": count("missing")})
    return counted.withColumn(payload, rewrite(F.col(payload), kind, repaired)).select(*records.columns, "n_updated", "n_missing")


def repair_statistics(repaired: DataFrame) -> DataFrame:
    """(n_records, n_rewritten, n_updated, n_missing) of repaired records."""
    return repaired.agg(F.count("*").alias("n_records"), F.count_if(F.col("n_updated") > 0).alias("n_rewritten"), F.coalesce(F.sum("n_updated"), F.lit(0)).alias("n_updated"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"))
