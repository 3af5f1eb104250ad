"""Queries on the matters of meetings: items of whole texts, summaries and listings; Spark plans with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import extract, graph
from tessera.plans.registry import add, t
from tessera.plans.search import CHUNK_PARTS


def _minutes(spark, sf):
    """Texts of the given tables as minutes: common words become references, readings, repeals and motions."""
    def spoken(c, n):
        c = F.regexp_replace(c, "(^|[.] )(The|Is|And|Le|Der) ", F.concat(F.lit("$1Bylaw No. "), n, F.lit(" ")))
        c = F.regexp_replace(c, " (by|pour|auf) ([a-z])", F.concat(F.lit(" Zoning Bylaw Amendment 2021 No. "), n, F.lit(".01, $2")))
        c = F.regexp_replace(c, "(^|\n)(Th|An|Re|De|Un)([a-z]+) ", "$1Council approved $3 ")
        c = F.regexp_replace(c, " (that|dans|nicht) ([a-z])", F.concat(F.lit(" repeals Bylaw 2000 and Fire Bylaw 4"), n, F.lit(" was amended by Bylaw "), n, F.lit(" $2")))
        return F.regexp_replace(c, " (is|les|ein) ", " third reading, ")

    docs = t(spark, sf, "documents")
    number = (100 + F.col("doc_id") % 400).cast("string")
    minutes = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), spoken(F.col("text"), number).alias("body"), F.concat(F.lit("2024-01-1"), (F.col("doc_id") % 10).cast("string")).alias("date"),
        F.concat(F.initcap("source"), F.lit(" committee")).alias("meeting_title"), F.lit("").alias("meeting_group"), F.lit("minutes").alias("source_kind"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("document_url"),
    )
    talks = t(spark, sf, "conversations")
    number = (100 + F.col("conv_id") % 400).cast("string")
    summaries = talks.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), spoken(F.col("text"), number).alias("body"), F.lit(None).cast("string").alias("date"),
        F.lit("Regular Council").alias("meeting_title"), F.lit(None).cast("string").alias("meeting_group"), F.lit("Council summary").alias("source_kind"), F.lit(None).cast("string").alias("document_url"),
    )
    return minutes.unionByName(summaries)


def _known(spark, sf):
    """Records with repeated numbers, of which the last counts."""
    part = t(spark, sf, "part")
    return part.select((100 + F.col("p_partkey") % 150).cast("string").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("department"), F.col("p_partkey").alias("position"))


def _spoken_sql(n: str) -> str:
    steps = [
        ("'(^|[.] )(The|Is|And|Le|Der) '", f"'\\1Bylaw No. ' || {n} || ' '"), ("' (by|pour|auf) ([a-z])'", f"' Zoning Bylaw Amendment 2021 No. ' || {n} || '.01, \\2'"),
        ("'(^|\\n)(Th|An|Re|De|Un)([a-z]+) '", "'\\1Council approved \\3 '"), ("' (that|dans|nicht) ([a-z])'", f"' repeals Bylaw 2000 and Fire Bylaw 4' || {n} || ' was amended by Bylaw ' || {n} || ' \\2'"),
        ("' (is|les|ein) '", "' third reading, '"),
    ]
    out = "text"
    for pattern, to in steps:
        out = f"regexp_replace({out}, {pattern}, {to}, 'g')"
    return out


def _relationships_sql() -> dict[str, str]:
    """SQL of each relationship's sorted numbers, by the same fixed patterns, for columns chunk and number."""
    quoted = lambda p, g, word: f"CASE WHEN contains(lower(chunk), '{word}') THEN regexp_extract_all(chunk, '(?is){p.replace(chr(39), chr(39) * 2)}', {g}) ELSE [] END"
    lists = {kind: [quoted(p, 1, graph.STEMS[kind]) for p in patterns] for kind, patterns in graph.FORWARD.items()} | {kind: [] for kind in graph.REVERSE.values()}
    lists["amends"].append("CASE WHEN contains(number, '.') THEN [string_split(number, '.')[1]] ELSE [] END")
    for kind, (verb, forward) in graph.PASSIVE.items():
        p = rf"{graph.REF}\s+(?:was|is|has\s+been)?\s*{verb}\s+by\s+{graph.REF}"
        pairs = f"list_zip({quoted(p, 1, verb)}, {quoted(p, 2, verb)})"
        lists[kind].append(f"list_transform(list_filter({pairs}, lambda z: z[1] = number), lambda z: z[2])")
        lists[forward].append(f"list_transform(list_filter({pairs}, lambda z: z[2] = number), lambda z: z[1])")
    return {kind: f"list_sort(list_distinct(list_filter(flatten([{', '.join(found) or '[]::VARCHAR[]'}]), lambda x: x <> number AND x <> '')))" for kind, found in lists.items()}


def _items_sql() -> str:
    pattern = r"(?i)\bBylaw(?:\s+Amendment)?(?:\s+[0-9]{4})?\s+(?:No\.?\s*)?([0-9]{3,4}(?:\.[0-9]+)*)"
    relations = _relationships_sql()
    forward = ", ".join(graph.REVERSE)
    actions = " ".join(f"WHEN contains(lower(chunk), '{w}') THEN " + ("CASE WHEN regexp_extract(lower(chunk), '\\b(?:first|second|third|three)\\s+readings?\\b') = '' THEN 'Reading' ELSE array_to_string(list_transform(string_split(regexp_extract(lower(chunk), '\\b(?:first|second|third|three)\\s+readings?\\b'), ' '), lambda x: upper(x[1]) || x[2:]), ' ') END" if w == "reading" else f"'{w.title()}'") for w in text.ACTION_WORDS)
    return rf"""
WITH src AS (SELECT 'd' || doc_id AS key, {_spoken_sql("(100 + doc_id % 400)")} AS text, '2024-01-1' || (doc_id % 10) AS date, upper(source[1]) || source[2:] || ' committee' AS meeting_title, 'committee' AS meeting_group, 'minutes' AS source_kind, 'https://example.org/' || doc_id AS source_document_url FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, {_spoken_sql("(100 + conv_id % 400)")}, NULL, 'Regular Council', 'council', 'Council summary', NULL FROM conversations),
parts AS (SELECT * EXCLUDE (text), {CHUNK_PARTS} AS parts FROM src),
each AS (SELECT * EXCLUDE (parts), generate_subscripts(parts, 1) AS part, replace(unnest(parts), '<DOT>', '.') AS whole FROM parts),
wrapped AS (SELECT * EXCLUDE (whole), unnest(range(0, CAST(ceil(length(whole) / 2400.0) AS BIGINT))) AS k, whole FROM each),
chunks AS (SELECT * EXCLUDE (whole), trim(substr(whole, k * 2400 + 1, 2400)) AS chunk FROM wrapped WHERE trim(substr(whole, k * 2400 + 1, 2400)) <> ''),
acted AS (SELECT *, CASE {actions} ELSE 'Discussed' END AS action FROM chunks),
found AS (SELECT *, regexp_extract_all(chunk, '{pattern}') AS ms, regexp_extract_all(chunk, '{pattern}', 1) AS ns, string_split_regex(chunk, '{pattern}') AS gaps FROM acted WHERE contains(lower(chunk), 'bylaw')),
placed AS (SELECT * EXCLUDE (ms, ns, gaps), unnest(ns) AS number, unnest(list_transform(ms, lambda m, i: 1 + coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS place FROM found),
titled AS (SELECT *, string_split(number, '.')[1] AS base_number, trim(trim(trim(regexp_extract(substr(chunk, CAST(greatest(place - 180, 1) AS BIGINT), CAST(least(place - 1, 180) AS BIGINT)), '[^.!?;]*$')), '“”" :-–—') || ' Bylaw No. ' || number) AS own FROM placed),
known AS (SELECT CAST(100 + p_partkey % 150 AS VARCHAR) AS number, max_by(p_name, p_partkey) AS title, max_by(p_type, p_partkey) AS category, max_by({{'d': CASE WHEN p_size > 25 THEN p_brand END}}, p_partkey).d AS department FROM part GROUP BY 1),
met AS (SELECT t.*, CASE WHEN length(own) BETWEEN 10 AND 240 THEN own ELSE 'Bylaw ' || t.number END AS short, x.number IS NOT NULL OR b.number IS NOT NULL AS matched, CASE WHEN x.number IS NOT NULL THEN x.title ELSE b.title END AS known_title, CASE WHEN x.number IS NOT NULL THEN x.category ELSE b.category END AS category, CASE WHEN x.number IS NOT NULL THEN x.department ELSE b.department END AS department
  FROM titled t LEFT JOIN known x ON x.number = t.number LEFT JOIN known b ON b.number = base_number),
related AS (SELECT *, {', '.join(f'{sql} AS {kind}' for kind, sql in relations.items())} FROM met),
bylaws AS (SELECT key, part, k, place, substr(sha256('bylaw|' || coalesce(date, 'None') || '|' || number || '|' || action), 1, 16) AS id, date, meeting_title, meeting_group, source_kind, source_document_url, 'Bylaw' AS type, number, base_number, concat_ws(';', {', '.join(f"array_to_string({kind}, ',')" for kind in relations)}) AS relationships,
  array_to_string(list_sort(list_distinct(flatten([{forward}]))), ',') AS relationship_targets, CASE WHEN matched AND lower(short) IN (lower('Bylaw ' || number), lower('Bylaw No. ' || number)) THEN coalesce(nullif(known_title, ''), short) ELSE short END AS title, action, substr(chunk, 1, 700) AS summary, category, department, matched AS matched_bylaw,
  CASE WHEN matched THEN 'bylaws/detail.html?number=' || base_number END AS bylaw_detail_url FROM related),
motions AS (SELECT key, part, k, 0 AS place, substr(sha256('motion|' || coalesce(date, 'None') || '|' || lower(chunk)), 1, 16) AS id, date, meeting_title, meeting_group, source_kind, source_document_url, 'Motion' AS type, NULL AS number, NULL AS base_number, NULL AS relationships, NULL AS relationship_targets, substr(chunk, 1, 180) AS title, action, substr(chunk, 1, 700) AS summary,
  NULL AS category, NULL AS department, false AS matched_bylaw, NULL AS bylaw_detail_url FROM acted WHERE regexp_matches(chunk, '^({'|'.join(text.MOTION_OPENINGS)})') AND NOT contains(lower(chunk), 'bylaw')),
both_ AS (SELECT * FROM bylaws UNION ALL SELECT * FROM motions)
SELECT * EXCLUDE (part, k, place) FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY part, k, place) AS r FROM both_) WHERE r = 1"""


@add("extract_items", f"SELECT * EXCLUDE (r) FROM ({_items_sql()})")
def extract_items(spark, sf):
    found = extract.items(_minutes(spark, sf), _known(spark, sf), "key", "body", "position")
    listed = F.when(F.col("relationships").isNotNull(), F.concat_ws(";", *[F.array_join(f"relationships.{k}", ",") for k in graph.KINDS]))
    found = found.withColumns({"relationships": listed, "relationship_targets": F.array_join("relationship_targets", ",")})
    return found.drop("meeting_url", "local_document", "source_text")
