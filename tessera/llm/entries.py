"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arc, bpe, class_lm, collocation, decontam, fim, jaccard, line_dedup, packing, pii, toxicity, url_reputation, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The listed URL rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of its id (0 is bad)."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting spark.tessera.pii.key; the synthetic tables hold nobody's data and need no secret."""
    key = spark.conf.get("spark.tessera.pii.key", "of the synthetic tables")
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return done.select("doc_id", "text", F.size("pii").alias("n_pii"), F.array_join(F.transform("pii", lambda x: x.kind), " ").alias("kinds"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.fit_and_score(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(table(spark, sf_dir, "documents"), with_output=False).drop("output")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_class_lm": op5_class_lm,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_warc_from_arc": op8_warc_from_arc,
    "op9_winnowing": op9_winnowing,
    "op10_decontamination": op10_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_packing": op13_packing,
}


def _level(units: str, parents: str, parent: str, floor: float = 2.0, ceiling: float = 1000.0) -> str:
    """SQL of url_reputation's posterior of each unit under its parent's prior."""
    return f"""(WITH j AS (SELECT u.*, p.mean AS prior FROM {units} u JOIN {parents} p USING ({parent})),
      s AS (SELECT {parent}, sum(n) AS tn, sum(n * (bad / greatest(n, 1)::DOUBLE - prior) ** 2) AS ss, count(*) AS k FROM j GROUP BY {parent}),
      r AS (SELECT j.*, prior * (1 - prior) AS var, (ss / (prior * (1 - prior)) - k) / greatest(tn - k, 1) AS rho FROM j JOIN s USING ({parent})),
      w AS (SELECT *, CASE WHEN var > 0 AND rho > 0 THEN greatest({floor}, least({ceiling}, 1 / rho - 1)) ELSE {ceiling} END AS strength FROM r)
      SELECT * EXCLUDE (prior, var, rho, strength), (bad + strength * prior) / (n + strength) AS mean, n + strength AS weight FROM w)"""


def _url_oracle() -> str:
    hit = verdict = "NULL"
    for kind, rule in sorted(URL_RULES, key=lambda x: len(x[1])):
        name, path = rule.split("/", 1)
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{path}')"
        hit, verdict = f"CASE WHEN {fits} THEN '{rule}' ELSE {hit} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    pattern = r"'^.*?://([^/?#]*)([^?#]*)'"
    address, two = r"regexp_matches(name, '^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$')", ", ".join(f"'{x}'" for x in url_reputation.SUFFIXES)
    last = lambda n: f"array_to_string(string_split(name, '.')[-{n}:], '.')"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, {pattern}, 1, 's'), ''), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host, coalesce(regexp_extract(url, {pattern}, 2, 's'), '') AS path FROM pages),
marks AS (SELECT doc_id AS page_id, max(CAST(quality = 0 AS INT)) AS bad FROM labels GROUP BY doc_id),
v AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(?::[0-9]*)?$', '') AS name FROM u LEFT JOIN marks USING (page_id)),
h AS (SELECT host, CASE WHEN {address} THEN name WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {address} THEN name WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix, 1 AS all_, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM v GROUP BY host, name),
d AS (SELECT domain, suffix, all_, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, all_, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
world AS (SELECT all_, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM x GROUP BY all_),
x2 AS {_level("x", "world", "all_")}, d2 AS {_level("d", "x2", "suffix")}, h2 AS {_level("h", "d2", "domain")}
SELECT page_id, host, path, {hit} AS rule, coalesce({verdict}, CASE WHEN h2.mean - 1.645::DOUBLE * sqrt(h2.mean * (1 - h2.mean) / (weight + 1)) > world.mean THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN h2 USING (host), world
"""


_BASE32 = "list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) >> b) & 31) + 1, 1)), lambda p, q: p || q)), lambda p, q: p || q)"


ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
""",
    "op1_url_filters": _url_oracle(),
    "op8_warc_from_arc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p
""",
    "op2_line_dedup": line_dedup.oracle(),
    "op11_fill_in_middle": fim.oracle(),
    "op12_phrase_collocations": collocation.oracle(),
}
