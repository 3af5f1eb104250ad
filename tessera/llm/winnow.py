"""Document fingerprints by winnowing, in DataFrame expressions only.

A rolling hash (rotate and xor of word hashes) covers every K consecutive words; in each window of W
consecutive hashes the smallest is selected, the rightmost on ties, with its place. Any passage of at least
W + K - 1 words that two texts share puts a common selected hash into both fingerprints. A selected hash and
its place are one long: 31 hash bits above 32 bits that fall with the place, so that the smallest long is the
rightmost minimum.

Defined results: null counts as empty; a text without words has an empty fingerprint; a text of fewer
than K words is one gram; fewer than W grams are one window; equal texts have equal fingerprints;
likeness is the Jaccard similarity of the sets of hashes, 1 for two empty ones. Ids are integers; those that
share an id are ordered by a hash of their text, rows that share id and text are one document, and null ids
come last. Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.store import cut

K = 5
#: A power of two: the windowed minimum is built by doubling.
W = 16
#: Ids of a part of the order aimed at, and the bound on the number of parts, whose edges (8 bytes each) are in the plan.
PART_IDS, MAX_PARTS = 50_000, 1 << 16


def _turned(x: str, n: int) -> str:
    return f"shiftleft({x}, {n}) ^ shiftrightunsigned({x}, {64 - n})"


def with_fingerprint(df: DataFrame, text: str, out: str, w: int = W) -> DataFrame:
    """Add ``out``: the selected (hash, place) longs of column ``text`` in order of place.

    Each step is a column of its own: an array that two later places use is then computed once.
    """
    t = f"_{out}_"

    def later(first: str, second: str, step: int, f: str) -> Column:
        """Each element of ``first`` with that of ``second`` ``step`` places later."""
        n = f"greatest(size(`{t}{second}`) - {step}, 0)"
        return F.expr(f"zip_with(slice(`{t}{first}`, 1, {n}), slice(`{t}{second}`, {step + 1}, {n}), (x, y) -> {f})")

    df = df.withColumn(t + "w", F.expr(rf"transform(filter(split(lower(coalesce(`{text}`, '')), '[ \\t-\\r]+'), x -> x != ''), x -> xxhash64(x))"))
    df = df.withColumn(t + "w2", later("w", "w", 1, f"{_turned('x', 7)} ^ y")).withColumn(t + "w4", later("w2", "w2", 2, f"{_turned('x', 14)} ^ y"))
    df = df.withColumn(t + "w5", later("w4", "w", K - 1, f"{_turned('x', 7)} ^ y"))
    df = df.withColumn(t + "g", F.expr(f"CASE WHEN size(`{t}w`) BETWEEN 1 AND {K - 1} THEN array(xxhash64(`{t}w`)) ELSE `{t}w5` END"))
    df = df.withColumn(t + "0", F.expr(f"transform(`{t}g`, (x, i) -> shiftleft(shiftrightunsigned(x, 33), 32) + (4294967295L - i))"))
    step, level = 1, 0
    while step < w:
        df = df.withColumn(f"{t}{level + 1}", later(str(level), str(level), step, "least(x, y)"))
        # a text of fewer windows keeps what it has
        df = df.withColumn(f"{t}{level + 1}", F.expr(f"if(size(`{t}{level + 1}`) = 0, if(size(`{t}{level}`) = 0, `{t}{level}`, array(array_min(`{t}{level}`))), `{t}{level + 1}`)"))
        step, level = step * 2, level + 1
    df = df.withColumn(out, F.expr(f"array_distinct(`{t}{level}`)"))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def as_string(fingerprint: Column) -> Column:
    """``hash@place`` in hexadecimal, in order of place, separated by blanks."""
    place = lambda x: F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), F.hex(place(x)))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def part_of(value: str, edges: list[int]) -> Column:
    """How many of the ascending edges are below a column's value, by halving."""
    if not edges:
        return F.lit(0)
    limits, steps = F.array(*[F.lit(x) for x in edges]), [1 << i for i in reversed(range(len(edges).bit_length()))]
    below = lambda at: F.coalesce(F.get(limits, at - 1) < F.col(value), F.lit(False))
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def next_ids(ids: DataFrame) -> DataFrame:
    """(_key, _null, _rid, _half, _next_key, _next_rid): the row that follows in descending order; the first one follows the last.

    ``ids`` has distinct rows of _key, _null (whether the id is null; these come last), _rid (a hash) and _half, no
    texts. The range of keys is cut into parts of about equal counts, at most MAX_PARTS, whose edges and
    first rows come to the driver; a window inside each part does the rest.
    """
    spark, total = ids.sparkSession, ids.count()
    n = max(1, min(MAX_PARTS, total // PART_IDS))
    edges = sorted(set(ids.where("NOT _null").agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    # parts ascend with the key; null ids are in the lowest, -1
    placed = ids.withColumn("_part", F.when(F.col("_null"), F.lit(-1)).otherwise(part_of("_key", edges)))
    firsts = {r._part: r.f for r in placed.groupBy("_part").agg(F.max(F.struct("_key", "_rid")).alias("f")).collect()}
    order = sorted(firsts, reverse=True)
    after = [(b, *firsts[order[(i + 1) % len(order)]]) for i, b in enumerate(order)]
    follow = spark.createDataFrame(after, "_part int, _after_key long, _after_rid long")
    window = Window.partitionBy("_part").orderBy(F.col("_key").desc(), F.col("_rid").desc())
    out = placed.withColumn("_next", F.lead(F.struct("_key", "_rid")).over(window)).join(F.broadcast(follow), "_part")
    value = lambda c: F.when(F.col("_next").isNull(), F.col(f"_after{c}")).otherwise(F.col(f"_next.{c}")).alias(f"_next{c}")
    return out.select("_key", "_null", "_rid", "_half", value("_key"), value("_rid"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Edited: the last half (floor) of the code points is replaced by as many of the next document's first. The
    order is made of ids alone; texts are shuffled once, and of next documents only the needed beginnings
    and the hashes.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"), F.col(key).isNull().alias("_null"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_rid", F.xxhash64("_text", "_null"))
    linked = cut(next_ids(cut(rows.select("_key", "_null", "_rid", F.floor(F.length("_text") / 2).cast("int").alias("_half")).distinct(), "ids")), "order")
    # both joins below read these columns alone, so that one shuffle serves them
    rows = rows.select("_key", "_rid", "_text")
    # what a document's predecessor needs of it, under the predecessor's id
    ahead = rows.join(linked.select(F.col("_key").alias("_for"), F.col("_rid").alias("_for_rid"), F.col("_null").alias("_for_null"), "_half", F.col("_next_key").alias("_key"), F.col("_next_rid").alias("_rid")), ["_key", "_rid"])
    ahead = with_fingerprint(ahead, "_text", "_fp")
    ahead = ahead.select(F.col("_for").alias("_key"), F.col("_for_rid").alias("_rid"), F.col("_for_null").alias("_null"), F.expr("substring(_text, 1, _half)").alias("_tail"), hashes(F.col("_fp")).alias("_c"))
    ahead = ahead.groupBy("_key", "_rid").agg(F.first("_null").alias("_null"), F.first("_tail").alias("_tail"), F.first("_c").alias("_c"))
    pairs = rows.join(ahead, ["_key", "_rid"]).withColumn("n_chars", F.length("_text").cast("long"))
    pairs = pairs.withColumn("_edited", F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 2) AS int))"), "_tail"))
    pairs = with_fingerprint(with_fingerprint(pairs, "_text", "_own"), "_edited", "_changed")
    pairs = pairs.withColumns({"_a": hashes(F.col("_own")), "_b": hashes(F.col("_changed"))})
    return pairs.select(
        F.when(~F.col("_null"), F.col("_key").cast(kind)).alias(key), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_string(F.col("_own")).alias("fingerprint"),
        as_string(F.col("_changed")).alias("edited_fingerprint"), likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"),
    )
