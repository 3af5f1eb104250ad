"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Every token with a digit becomes ``#``, every capitalised one ``@`` and every unit after a number ``~``;
the rest is lower-cased. The folded template has no ``@``: names are lower-cased too, so it is the same for
copies in capitals or in small letters. Windows of WINDOW tokens of both, hashed by a rolling hash (rotate and
xor), are hash-joined with those of the benchmark's items. A document is a candidate for an item when it has at least CONTAINMENT of the item's
distinct windows, of one template or of the other. For candidates the slots are compared, in lower case:
each value of an item must stand for one and the same value throughout one occurrence,
or throughout the document (a
re-parameterised question renames consistently, chance matches don't). At least CONSISTENCY of the slots
must agree.

Defined results: null and empty texts have no windows; an item of fewer than WINDOW tokens is one window
and only matches a text that is the same short template; windows with fewer than LITERALS literal words
are no evidence in the template, and stand for themselves, as written in lower case, in the folded one;
repeated items or ids count once each by id (their windows are united); a null id is ignored. Columns
other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import salted_join
from tessera.llm.store import cut, discard

WINDOW = 5
CONTAINMENT = 0.8
CONSISTENCY = 0.8
LITERALS = 2
#: Benchmark windows (up to some 200 bytes each with their slots) and ids of candidates are broadcast up to these
#: counts; more are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_IDS = 500_000, 1_000_000
#: Units of measure, money and time.
UNITS = "km m cm mm kg g mg lb lbs oz miles mile feet foot ft inches inch yards yard l ml liters litres gallons gallon seconds second minutes minute hours hour days day weeks week months month years year dollars dollar cents cent euros euro pounds pound percent degrees degree mph kph watts volts".split()
_S = r" \\t-\\r"
_TOKEN_START = rf"(?<![^{_S}])"


def _tokens(flat: str) -> str:
    return f"if({flat} = '', cast(array() AS array<string>), split({flat}, ' '))"


def _rolled(df: DataFrame, flat: str, out: str) -> DataFrame:
    """Add ``out``: the hashes of all windows of WINDOW tokens of the blank-separated string ``flat``; of fewer
    tokens, one hash of all."""
    turned = lambda x, n: f"shiftleft({x}, {n}) ^ shiftrightunsigned({x}, {64 - n})"

    def rolled(first: str, second: str, step: int, by: int) -> Column:
        """Each hash of ``first``, turned, with that of ``second`` ``step`` tokens later."""
        count = f"greatest(size({second}) - {step}, 0)"
        return F.expr(f"zip_with(slice({first}, 1, {count}), slice({second}, {step + 1}, {count}), (a, b) -> {turned('a', by)} ^ b)")

    df = df.withColumn("_h1", F.expr(f"transform({_tokens(flat)}, x -> xxhash64(x))"))
    df = df.withColumn("_h2", rolled("_h1", "_h1", 1, 7)).withColumn("_h4", rolled("_h2", "_h2", 2, 14))
    df = df.withColumn("_h5", rolled("_h4", "_h1", WINDOW - 1, 7))
    return df.withColumn(out, F.expr(f"CASE WHEN size(_h1) BETWEEN 1 AND {WINDOW - 1} THEN array(xxhash64(_h1, {WINDOW})) ELSE _h5 END")).drop("_h1", "_h2", "_h4", "_h5")


def with_template(df: DataFrame, text: str, written: bool) -> DataFrame:
    """Add the strings _plain (lower case), _canon (template) and _folded (folded template) of as many
    blank-separated tokens, and the hashes of their windows: _grams, _folds and, if ``written``, _words."""
    df = df.withColumn("_flat", F.expr(f"trim(regexp_replace(coalesce(`{text}`, ''), '[{_S}]+', ' '))"))
    df = df.withColumn("_numbered", F.expr(f"regexp_replace(_flat, '{_TOKEN_START}[^ 0-9]*[0-9][^ ]*', '#')"))
    named = f"regexp_replace(_numbered, '{_TOKEN_START}\\\\p{{Lu}}[^ ]*', '@')"
    units = lambda x: F.expr(f"regexp_replace(lower({x}), '# (?:{'|'.join(UNITS)})(?![a-z])[^ ]*', '# ~')")
    df = df.withColumns({"_plain": F.expr("lower(_flat)"), "_canon": units(named), "_folded": units("_numbered")}).drop("_flat", "_numbered")
    df = _rolled(_rolled(df, "_canon", "_grams"), "_folded", "_folds")
    return _rolled(df, "_plain", "_words") if written else df


def _windows(df: DataFrame, ids: list[str]) -> DataFrame:
    """A row per window of a frame with _words: ids, p (its place), and _t, _f and _w, the windows (g) of the template, the folded
    template and the text, with the values of its slots in order (s) and the number of its literal words (n)."""
    for name in ("_plain", "_canon", "_folded"):
        df = df.withColumn(f"{name}_t", F.expr(_tokens(name)))
    slots = lambda canon: f"filter(zip_with(slice(_plain_t, p + 1, {WINDOW}), slice({canon}_t, p + 1, {WINDOW}), (a, b) -> if(b IN ('#', '@', '~'), a, NULL)), x -> x IS NOT NULL)"
    literal = lambda canon: f"size(filter(slice({canon}_t, p + 1, {WINDOW}), x -> x NOT IN ('#', '@', '~')))"
    kinds = [("_grams", "_canon", "_t"), ("_folds", "_folded", "_f")]
    made = ", ".join(f"named_struct('g', w.{grams}, 's', {slots(canon)}, 'n', {literal(canon)}) AS {name}" for grams, canon, name in kinds)
    # the slots are cut out before the rows are made: a row of a window doesn't hold its whole text
    rows = F.expr(f"transform(arrays_zip(_grams, _folds, _words), (w, p) -> struct(p AS p, {made}, w._words AS _w))")
    return df.select(*ids, F.explode_outer(rows).alias("_v")).where("_v IS NOT NULL").select(*ids, "_v.*")


#: What a window is matched by: its template, its folded form and, with few literal words, itself.
_WAYS = f"""filter(array(
    struct(false AS k, if(_t.n >= {LITERALS}, _t.g, NULL) AS w, _t.g AS g, _t.s AS s),
    struct(false AS k, if(_t.n >= {LITERALS} AND _t.g <> _f.g AND _f.n >= {LITERALS}, _t.g, NULL) AS w, _f.g AS g, _f.s AS s),
    struct(true AS k, if(_f.n >= {LITERALS}, _f.g, NULL) AS w, _f.g AS g, _f.s AS s),
    struct(true AS k, if(_f.n < {LITERALS}, _w, NULL) AS w, _w AS g, cast(array() AS array<string>) AS s)), x -> x.w IS NOT NULL)"""


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, _folds (whether the rows are of the folded template), _w (a window), p, _gram and _slots (what
    matches it), _of (the number of the item's distinct windows), _length (of tokens) and _written (whether the
    match is with the text as written).

    A window of the template is also matched by its folded form, in which names are written out.
    """
    own = with_template(benchmark.select(F.col(item), F.col(text).alias("_text")).where(F.col(item).isNotNull()), "_text", True).withColumn("_length", F.size(F.expr(_tokens("_plain"))))
    rows = _windows(own, [item, "_length"]).withColumn("_way", F.explode_outer(F.expr(_WAYS))).where("_way IS NOT NULL")
    rows = rows.select(item, F.col("_way.k").alias("_folds"), F.col("_way.w").alias("_w"), "p", F.col("_way.g").alias("_gram"), F.col("_way.s").alias("_slots"), "_length", F.expr(f"_way.k AND _f.n < {LITERALS}").alias("_written"))
    sizes = rows.groupBy(item, "_folds").agg(F.countDistinct("_w").alias("_of"))
    return rows.join(sizes, [item, "_folds"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(_key, _item, n_matched, n_windows, containment, consistency) of every match that holds."""
    bench = cut(benchmark_windows(benchmark.select(F.col(item).alias("_item"), F.col(text)), "_item", text), "windows")
    n, written = bench.agg(F.count("*"), F.max("_written")).first()
    match = ["_key", "_item", "_folds"]

    def with_windows(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "_gram") if n <= BROADCAST_WINDOWS else salted_join(left, right, "_gram")

    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL")
    # windows of texts that have few literal words can only meet those that the benchmark has of this kind
    every = "concat(_grams, _folds, _words)" if written else "concat(_grams, _folds)"
    templated = with_template(texts, "_text", bool(written))
    seen = templated.select("_key", F.explode_outer(F.expr(f"array_distinct({every})")).alias("_gram")).where("_gram IS NOT NULL")
    hits = with_windows(seen, bench.select("_item", "_folds", "_w", "_gram", "_of").distinct())
    # rows that share an id are one document: what repeats there is counted once
    counts = hits.select(*match, "_of", "_w").distinct().groupBy(*match, "_of").agg(F.count("*").alias("n_matched"))
    wanted = cut(counts.where(F.col("n_matched") >= CONTAINMENT * F.col("_of")), "wanted")

    # slots: only candidates' texts are looked at again
    ids = wanted.select("_key").distinct()
    few = wanted.count() <= BROADCAST_IDS
    again = with_template(texts.join(F.broadcast(ids) if few else ids, "_key"), "_text", True).withColumn("_row", F.xxhash64("_plain"))
    ways = "array_distinct(array(struct(_t.g AS g, _t.s AS s), struct(_f.g AS g, _f.s AS s), struct(_w AS g, cast(array() AS array<string>) AS s)))"
    windows = _windows(again, ["_key", "_row"]).withColumn("_way", F.explode_outer(F.expr(ways))).select("_key", "_row", "p", F.col("_way.g").alias("_gram"), F.col("_way.s").alias("_slots"))
    mine = bench.select("_item", "_folds", "_w", "_gram", F.col("p").alias("q"), F.col("_slots").alias("_theirs"), "_length")
    paired = with_windows(windows, mine).where("size(_slots) = size(_theirs)")
    chosen = wanted.select(*match)
    paired = cut(paired.join(F.broadcast(chosen) if few else chosen, match), "paired")

    # where a match is judged: in the whole document; in an occurrence of the same length, whose windows are all
    # at one distance from the item's; in one that is longer or shorter, at distances within the item's length,
    # by buckets that overlap by half. Other occurrences start an item's length away, in no bucket of these.
    judged_at = paired.withColumns({"_off": F.expr("cast(p - q AS bigint)"), "_half": F.expr("cast(greatest(_length DIV 2, 1) AS bigint)")})
    bucket = "cast(floor(_off / _half) AS bigint)"
    places = F.expr(f"array(struct(0 AS k, 0L AS row, 0L AS at), struct(1 AS k, _row AS row, _off AS at), struct(2 AS k, _row AS row, {bucket} AS at), struct(2 AS k, _row AS row, {bucket} - 1 AS at))")
    places = judged_at.select(*match, "_w", F.arrays_zip("_theirs", "_slots").alias("_values"), F.explode(places).alias("_place"))
    covered = places.groupBy(*match, "_place").agg(F.countDistinct("_w").alias("_there"))
    values = places.select(*match, "_place", F.explode("_values").alias("_v")).select(*match, "_place", F.col("_v._theirs").alias("_was"), F.col("_v._slots").alias("_is"))
    tally = values.groupBy(*match, "_place", "_was", "_is").agg(F.count("*").alias("_c")).groupBy(*match, "_place", "_was").agg(F.max("_c").alias("_same"), F.sum("_c").alias("_all"))
    agree = tally.groupBy(*match, "_place").agg((F.sum("_same") / F.sum("_all")).alias("consistency"))
    judged = covered.join(agree, [*match, "_place"], "left").join(wanted, match).withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    judged = judged.where((F.col("_there") >= CONTAINMENT * F.col("_of")) & (F.col("consistency") >= CONSISTENCY))
    judged = judged.withColumn("containment", F.col("n_matched") / F.col("_of"))
    best = judged.groupBy("_key", "_item").agg(F.max_by(F.struct("n_matched", F.col("_of").alias("n_windows"), "containment", "consistency"), F.struct("containment", "consistency", ~F.col("_folds"))).alias("_best"))
    found = cut(best.select("_key", "_item", "_best.*"), "contaminated")
    for table in (bench, wanted, paired):
        discard(table)
    return found


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per document: contaminated, and its best matching item (most contained, then least id)."""
    found = contaminated(docs, benchmark, key, text, item)
    struct = F.struct(F.col("_item").alias(item), "n_matched", "n_windows", "containment", "consistency")
    # most contained, then the least id
    ranked = found.groupBy("_key").agg(F.count("*").alias("n_items"), F.max("containment").alias("_most"))
    best = found.join(ranked, "_key").where("containment = _most").groupBy("_key", "n_items").agg(F.min_by(struct, "_item").alias("_best"))
    joined = docs.select(F.col(key).alias("_key")).join(best, "_key", "left")
    return joined.select(F.col("_key").alias(key), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.expr("_best.*"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without those that contain an item of the benchmark."""
    ids = contaminated(docs, benchmark, key, text, item).select(F.col("_key").alias(key)).distinct()
    return docs.join(ids, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
