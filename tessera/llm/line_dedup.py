"""Line dedup over content-defined chunks of lines, in DataFrame expressions only.

A text is taken as a sequence of units: its lines, long ones cut inside after every UNIT_WORDS words. Equal
lines have equal units. A rolling hash covers each unit and the one after it; of every two neighbouring
rolling hashes the smaller one, the right one on ties, marks a boundary, so boundaries depend on the content
around them alone and shift with it. A chunk reaches from one boundary to the next, both units included,
so it has two or three units, and any passage of at least five units that two texts share has a chunk in
it: any shared run of whole lines with more than 4 * UNIT_WORDS words.

Chunks whose hash occurs in several documents are compared byte by byte with the one of the least id. A
match is then followed over at most LEFT units before it and RIGHT after it, so that a passage's ends outside
of its chunks go too. A run of at least LEAST_WORDS words goes from all documents but the one of
the least id. Single short lines, however frequent, never go.

Defined results: a null text is an empty text and stays null; rows that share an id are one document and
keep the same chunks; repeats inside one document stay; a null id is never the least and loses nothing;
other columns are untouched whatever their names, but for n_removed, which is replaced. What
is left of a text is its remaining units as they stood, line ends included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import salted_join
from tessera.llm.store import cut, discard

UNIT_WORDS, LEAST_WORDS = 12, 20
#: No passage has more units outside of its chunks.
LEFT, RIGHT = 1, 2
#: The places around a chunk: name, what it is counted from, and how far.
AROUND = [(f"l{k}", "s", -k) for k in range(1, LEFT + 1)] + [(f"r{k}", "e", k) for k in range(1, RIGHT + 1)]
#: A unit: up to UNIT_WORDS words of a line, with the blank or line end after them.
UNIT = rf"[^ \n]*(?: [^ \n]*){{0,{UNIT_WORDS - 1}}}(?:\n| |\z)"
#: The rolling hash over the hashes of a unit and the next one.
_R = "pmod(a + 31 * b, 4294967296)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n") + "'"


def _units(text: str) -> str:
    """SQL of a text's units, which joined are the text."""
    return f"filter(regexp_extract_all({text}, {_sql(UNIT)}, 0), x -> x <> '')"


def _bare(unit: str) -> str:
    """SQL of a unit without its end."""
    return f"trim(TRAILING ' \\n' FROM {unit})"


def with_chunks(df: DataFrame, text: str) -> DataFrame:
    """Add _chunks: (s, e, h), first and last unit from 1, and a hash of the units between them without their ends."""
    df = df.withColumn("_bare", F.expr(f"transform({_units(text)}, x -> {_bare('x')})"))
    df = df.withColumn("_hash", F.expr("transform(_bare, x -> cast(conv(substr(md5(x), 1, 8), 16, 10) AS bigint))"))
    df = df.withColumn("_rolling", F.expr(f"zip_with(slice(_hash, 1, greatest(size(_hash) - 1, 0)), slice(_hash, 2, greatest(size(_hash) - 1, 0)), (a, b) -> {_R})"))
    # a boundary is the smaller of two neighbours, the right one on ties
    before, after = "if(size(_rolling) > 0, array_prepend(slice(_rolling, 1, size(_rolling) - 1), -1L), _rolling)", "if(size(_rolling) > 0, array_append(slice(_rolling, 2, size(_rolling)), -1L), _rolling)"
    df = df.withColumns({"_before": F.expr(before), "_after": F.expr(after)})
    df = df.withColumn("_ends", F.expr("filter(transform(arrays_zip(_rolling, _before, _after), (x, i) -> if(x._rolling < x._after OR (x._rolling <= x._before AND x._before >= 0), i + 1, 0)), i -> i > 0)"))
    df = df.withColumn("_chunks", F.expr("zip_with(slice(_ends, 1, greatest(size(_ends) - 1, 0)), slice(_ends, 2, greatest(size(_ends) - 1, 0)), (s, e) -> named_struct('s', s, 'e', e, 'h', xxhash64(slice(_bare, s, e - s + 1))))"))
    return df.drop("_bare", "_hash", "_rolling", "_before", "_after", "_ends")


def repeated_runs(packed: DataFrame) -> DataFrame:
    """(_key, _rid, _gone): the places of the units that the rows of ``packed`` (_key, _rid, _text) lose."""
    texts = packed.where("_key IS NOT NULL")
    # the outer form, as a filter of empty arrays would be pushed below the making of the chunks and repeat it
    chunks = with_chunks(texts.select("_key", "_rid", "_text"), "_text").select("_key", "_rid", F.explode_outer("_chunks").alias("_c"))
    chunks = cut(chunks.where("_c IS NOT NULL").select("_key", "_rid", "_c.*"), "chunks")
    # hashes only: which ones occur in several documents
    shared = chunks.groupBy("h").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b")).where("_a < _b").select("h", "_a")
    shared = cut(shared, "shared")
    marks = salted_join(chunks, shared, "h").groupBy("_key", "_rid").agg(F.collect_set(F.struct("s", "e", "h", (F.col("_key") == F.col("_a")).alias("least"))).alias("_marks"))
    marks = cut(marks, "marks")
    for table in (chunks, shared):
        discard(table)
    # texts of the marked chunks and of the units around them, cut out before the rows are made: a row never holds a whole text
    marked = packed.join(marks, ["_key", "_rid"]).withColumn("_units", F.expr(_units("_text")))
    at = lambda place: _bare(f"if({place} BETWEEN 1 AND size(_units), element_at(_units, greatest({place}, 1)), NULL)")
    around = "".join(f", '{name}', {at(f'm.{end} + ({k})')}" for name, end, k in AROUND)
    body = f"transform(_marks, m -> named_struct('s', m.s, 'e', m.e, 'h', m.h, 'least', m.least, 'chunk', transform(slice(_units, m.s, m.e - m.s + 1), x -> {_bare('x')}){around}))"
    found = cut(marked.select("_key", "_rid", F.explode_outer(F.expr(body)).alias("_c")).select("_key", "_rid", "_c.*"), "marked")
    discard(marks)
    first = found.where("least").groupBy("h").agg(F.min_by(F.struct(F.col("_key").alias("_first"), *[F.col(c).alias(f"_{c}") for c in ("chunk", *[x[0] for x in AROUND])]), F.struct("_key", "_rid", "s")).alias("_ref")).select("h", "_ref.*")
    matched = salted_join(found.where("NOT least"), first, "h").where("chunk = _chunk")
    # how far a match goes on
    reach = {}
    for side, most in (("l", LEFT), ("r", RIGHT)):
        reach[f"_go_{side}"] = F.expr("CASE " + " ".join(f"WHEN {side}{k} IS NULL OR _{side}{k} IS NULL OR {side}{k} <> _{side}{k} THEN {k - 1}" for k in range(1, most + 1)) + f" ELSE {most} END")
    matched = matched.withColumns(reach)
    words = lambda x: f"if({x} = '', 0, length({x}) - length(replace({x}, ' ', '')) + 1)"
    total = f"aggregate(chunk, 0, (t, x) -> t + {words('x')})" + "".join(f" + if(_go_{name[0]} >= {abs(k)}, {words(name)}, 0)" for name, _, k in AROUND)
    places = matched.where(F.expr(f"{total} >= {LEAST_WORDS}")).select("_key", "_rid", (F.col("s") - F.col("_go_l")).alias("s"), (F.col("e") + F.col("_go_r")).alias("e"))
    runs = places.groupBy("_key", "_rid").agg(F.collect_set(F.struct("s", "e")).alias("_runs"))
    gone = cut(runs.select("_key", "_rid", F.expr("array_distinct(flatten(transform(_runs, r -> sequence(r.s, r.e))))").alias("_gone")), "gone")
    discard(found)
    return gone


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated runs in ``text``, plus n_removed (long): how many units went."""
    columns = [c for c in docs.columns if c != "n_removed"]
    others = [c for c in columns if c not in (key, text)]
    packed = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_rid"), F.col(text).alias("_text"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if others else []))
    # equal texts of one id lose the same units, so these two tell rows apart as far as needed
    done = packed.join(repeated_runs(packed), ["_key", "_rid"], "left")
    kept = f"element_at(transform(array({_units('_text')}), u -> transform(array_except(sequence(1, size(u)), _gone), i -> element_at(u, i))), 1)"
    values = {c: F.col(f"_row.`{c}`").alias(c) for c in others}
    values |= {key: F.col("_key").alias(key), text: F.expr(f"CASE WHEN _gone IS NULL THEN _text ELSE array_join({kept}, '') END").alias(text)}
    return done.select(*[values[c] for c in columns], F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL: doc_id, text, n_removed (for ids that aren't repeated)."""
    around = ", ".join(f"lead(bare, {k}) OVER w AS {name}" for name, _, k in AROUND)
    ends = ", ".join(f"arg_m{'in' if k < 0 else 'ax'}({name}, i) AS {name}" for name, _, k in AROUND)
    names = ["chunk", *[x[0] for x in AROUND]]
    first = ", ".join(f"'{c}': {c}" for c in names)
    reach = {side: "CASE " + " ".join(f"WHEN c.{side}{k} IS NULL OR f.{side}{k} IS NULL OR c.{side}{k} <> f.{side}{k} THEN {k - 1}" for k in range(1, most + 1)) + f" ELSE {most} END" for side, most in (("l", LEFT), ("r", RIGHT))}
    words = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ' ', '')) + 1 END"
    more = "".join(f" + CASE WHEN go_{name[0]} >= {abs(k)} THEN {words(name)} ELSE 0 END" for name, _, k in AROUND)
    unit = UNIT.replace("\n", "' || chr(10) || '")
    return f"""
WITH cutted AS (SELECT doc_id, text, list_filter(regexp_extract_all(coalesce(text, ''), '{unit}'), lambda x: x <> '') AS units FROM {table}),
u AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS i FROM cutted),
b AS (SELECT *, rtrim(unit, ' ' || chr(10)) AS bare FROM u),
h AS (SELECT *, ('0x' || substr(md5(bare), 1, 8))::BIGINT AS h FROM b),
r AS (SELECT *, (h + 31 * lead(h) OVER w) % 4294967296 AS r, {around} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, coalesce(r < lead(r) OVER w, false) OR coalesce(r <= lag(r) OVER w, false) AS mark FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, i AS s, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM m WHERE mark AND r IS NOT NULL),
c AS (SELECT doc_id, s, e, string_agg(bare, chr(10) ORDER BY i) AS chunk, sum({words('bare')}) AS n, {ends} FROM e JOIN m USING (doc_id) WHERE e IS NOT NULL AND i BETWEEN s AND e GROUP BY doc_id, s, e),
f AS (SELECT chunk, min(doc_id) AS first, arg_min({{{first}}}, (doc_id, s)) AS f FROM c GROUP BY chunk HAVING min(doc_id) < max(doc_id)),
g AS (SELECT c.*, {reach['l'].replace('f.', 'f.f.')} AS go_l, {reach['r'].replace('f.', 'f.f.')} AS go_r FROM c JOIN f ON c.chunk = f.chunk AND doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(s - go_l, e + go_r + 1)) AS i FROM g WHERE n{more} >= {LEAST_WORDS}),
left_ AS (SELECT u.doc_id, u.i, unit, gone.i IS NOT NULL AS gone FROM u LEFT JOIN gone USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(unit, '' ORDER BY i) FILTER (WHERE NOT gone) AS t, count(*) FILTER (WHERE gone) AS n FROM left_ GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(n, 0) AS n_removed FROM cutted LEFT JOIN t USING (doc_id)
"""
