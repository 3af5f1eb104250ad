"""Typed relationships between records: inference from text, inversion and derived status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a record is referred to, and the verbs of each relationship.
NUMBER = r"[0-9]{3,4}(?:\.[0-9]+)*"
BODY = r"(?:City\s+of\s+[A-Z][a-z]+\s+)?(?:[A-Z][A-Za-z0-9&,'’()\- ]{0,140}\s+)?Bylaw(?:\s+[0-9]{4})?(?:\s*,?\s*No\.?)?\s*"
REF = rf"{BODY}({NUMBER})"
# A reference from the word on: what stands before it in REF may be absent, so a pattern that begins with REF matches
# somewhere if and only if it does so with CORE in its place, which is found without trying every letter.
CORE = r"Bylaw(?:\s+[0-9]{4})?(?:\s*,?\s*No\.?)?\s*[0-9]{3,4}(?:\.[0-9]+)*"
FORWARD = {
    "amends": [rf"(?:amend(?:s|ed|ing)?|amendment\s+to)\s+(?:the\s+)?{REF}", rf"{REF}\s+(?:is\s+hereby\s+)?amend(?:ed|s)?"],
    "repeals": [
        rf"(?:repeal(?:s|ed|ing)?|hereby\s+repeal(?:s|ed)?)\s+(?:and\s+replace(?:s|d|ing)?\s+)?(?:the\s+)?{REF}",
        rf"{REF}\s+(?:is\s+hereby\s+)?repeal(?:ed|s)?",
        rf"{REF}(?:\s+and\s+(?:all\s+)?(?:its\s+)?amendments?)?\s+(?:is|are)\s+(?:hereby\s+)?repealed",
    ],
    "replaces": [rf"replace(?:s|d|ing)?\s+(?:the\s+)?{REF}", rf"{REF}\s+(?:is\s+hereby\s+)?replace(?:d|s)?", rf"{REF}\s+(?:is|are)\s+(?:hereby\s+)?replaced"],
    "consolidates": [rf"consolidat(?:e|es|ed|ing|ion)\s+(?:of\s+)?\s*(?:the\s+)?{REF}", rf"{REF}\s+(?:is\s+)?consolidat(?:ed|es)?"],
}
PASSIVE = {"replaced_by": ("replaced", "replaces"), "repealed_by": ("repealed", "repeals"), "amended_by": ("amended", "amends")}
REVERSE = {"amends": "amended_by", "repeals": "repealed_by", "replaces": "replaced_by", "consolidates": "consolidated_by"}
KINDS = [*REVERSE, *REVERSE.values()]


#: A word that each kind's patterns hold, so that texts without it needn't be searched.
STEMS = {"amends": "amend", "repeals": "repeal", "replaces": "replace", "consolidates": "consolidat"}


def mentions(text: Column) -> Column:
    """What a text says about any record: a struct of the numbers by forward relationship, and of (subject, actor) pairs
    by passive one. It depends on the text alone, so texts that many records share are searched once."""
    source = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.transform(F.array(source), _mentions)[0]  # so that the text is made once, not for each pattern


def _mentions(source: Column) -> Column:
    low = F.lower(source)
    none, no_pairs = F.array().cast("array<string>"), F.array().cast("array<struct<subject:string,actor:string>>")

    def every(pattern: str, group: int = 1) -> Column:
        listed = F.regexp_extract_all(source, F.lit(f"(?is){pattern}"), F.lit(group))
        # the body of a reference may begin at any letter, so a text is searched for it only where there is one
        return F.when(source.rlike(f"(?is){CORE}{pattern[len(REF):]}"), listed).otherwise(none) if pattern.startswith(REF) else listed

    found = [F.when(low.contains(STEMS[kind]), F.concat(*[every(p) for p in patterns])).otherwise(none).alias(kind) for kind, patterns in FORWARD.items()]
    for kind, (verb, _) in PASSIVE.items():
        pattern = rf"{REF}\s+(?:was|is|has\s+been)?\s*{verb}\s+by\s+{REF}"
        part = lambda m, group: F.regexp_extract(m, f"(?is){pattern}", group)  # noqa: B023, E731
        pairs = F.transform(every(pattern, 0), lambda m: F.struct(part(m, 1).alias("subject"), part(m, 2).alias("actor")))  # noqa: B023
        found.append(F.when(low.contains(f"{verb} by"), pairs).otherwise(no_pairs).alias(kind))
    return F.struct(*found)


def relate(number: Column, said: Column) -> Column:
    """A struct of sorted distinct numbers by relationship for one record, from the ``mentions`` of a text; the record's own
    number is left out, and an amendment's number names its base."""
    own = F.regexp_replace(F.trim(number), r"\.+$", "")
    none = F.array().cast("array<string>")
    found = {kind: [said[kind]] for kind in FORWARD} | {kind: [] for kind in REVERSE.values()}
    found["amends"].append(F.when(own.contains("."), F.array(F.substring_index(own, ".", 1))).otherwise(none))
    for kind, (_, forward) in PASSIVE.items():
        found[kind].append(F.transform(F.filter(said[kind], lambda x: x["subject"] == own), lambda x: x["actor"]))
        found[forward].append(F.transform(F.filter(said[kind], lambda x: (x["actor"] == own) & (x["subject"] != own)), lambda x: x["subject"]))
    tidy = lambda lists: F.array_sort(F.array_distinct(F.filter(F.concat(none, *lists), lambda x: (x != "") & (x != own))))
    return F.struct(*[tidy(found[kind]).alias(kind) for kind in KINDS])


def infer_relationships(number: Column, text: Column) -> Column:
    """A struct of sorted distinct numbers by relationship, the record's own left out."""
    return F.transform(F.array(mentions(text)), lambda said: relate(number, said))[0]


def targets(relationships: str) -> Column:
    """All forward targets of a relationships struct, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.col(f"{relationships}.{k}") for k in REVERSE])))


def edges(records: DataFrame, key: str, relationships: str) -> DataFrame:
    """(source, target, type) of the forward relationships."""
    listed = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{relationships}.{k}").alias("targets")) for k in REVERSE])
    each = records.select(F.col(key).alias("source"), F.explode(listed).alias("r"))
    return each.select("source", F.explode("r.targets").alias("target"), F.col("r.type").alias("type")).distinct()


def invert(edge_table: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Reverse edges (source, target, type_by) onto collected targets only."""
    known = records.select(F.col(key).alias("target")).distinct()
    renamed = F.create_map(*[F.lit(x) for pair in REVERSE.items() for x in pair])
    return edge_table.join(known, "target").select(F.col("target").alias("source"), F.col("source").alias("target"), F.coalesce(renamed[F.col("type")], F.concat(F.col("type"), F.lit("_by"))).alias("type"))


def enrich(edge_table: DataFrame, records: DataFrame, key: str, title: str) -> DataFrame:
    """Edges with both titles, and whether the target is collected; of records with equal keys the greatest title counts."""
    names = records.groupBy(F.col(key).alias("_k")).agg(F.max(title).alias("_t"))
    out = edge_table.join(names.select(F.col("_k").alias("source"), F.col("_t").alias("source_title")), "source", "left")
    out = out.join(names.select(F.col("_k").alias("target"), F.col("_t").alias("target_title"), F.lit(True).alias("_hit")), "target", "left")
    return out.withColumn("target_collected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def legal_status(has: dict[str, Column], text: Column) -> Column:
    """Precedence of a record's status; ``has`` tells which relationships are not empty."""
    return (
        F.when(has["repealed_by"], "Repealed").when(has["replaced_by"], "Replaced").when(has["amends"], "Amendment bylaw")
        .when(has["repeals"], "Repealing bylaw").when(has["replaces"], "Replacement bylaw")
        .when(F.lower(F.coalesce(text, F.lit(""))).contains("consolidat"), "Consolidated").otherwise("Published")
    )
