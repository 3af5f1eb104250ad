"""Phrase collocations from vertical positional inverted lists.

Texts are lower-cased and split into pieces and words once. Every block of documents becomes one row of the index: for
each word of a language the ascending list of its positions. Positions leave a gap wherever a piece or a text ends, so two
words stand side by side in a piece exactly when their positions differ by one. A phrase of k words is extended by
merge-joining its occurrence positions, moved on by k, with the postings; the lists that come out are the
occurrences of the longer phrases, and their lengths are exact frequencies, which Spark sums over the blocks. Neighbours never
lie in different blocks, so no list is shuffled, only lengths.

From one level to the next only phrases that are frequent enough are extended: a phrase is no more frequent than its parts.
Which ones are is told to the tasks by a bit filter of at most 2**FILTER_BITS bits, whatever their number. A false hit
costs a row and nothing else, since each level's sums are exact; so a large corpus is pruned less but never counted
otherwise.

Words are known by 64-bit hashes of language and word. No two words share one: the vocabulary is checked for that after
the index is made, and words that do get other numbers in an index made anew.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; words and
texts of any length are kept whole; equal scores rank by frequency, then by the bytes of the phrase; an empty table
gives an empty one. Columns other than the text and the language are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import column, gather, give_back, small
from tessera.llm.skew import salted_join
from tessera.llm.store import cut, discard, setting
from tessera.llm.words import Words, mix

#: The bytes that end a piece, and those that only separate words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text in a block, and texts that are looked at for one: together they bound what a task holds outside the heap.
BLOCK, TEXTS = 2 << 20, 500
#: Blocks in a file of the index: a task that reads one sums up the phrases of so many before they are shuffled.
BLOCKS = 4
#: Phrases that a task passes on at once.
PASSED = 1 << 14
#: Words whose spellings are compared at once.
SLICE = 1 << 15
#: At most 2**FILTER_BITS bits (16 MB) are sent to the tasks per level.
FILTER_BITS = 27
#: Words with one hash that may be given other numbers; more mean that the hash is broken.
CLASHES = 10_000
#: Rows of a table that is broadcast instead of shuffled.
FEW = 200_000

_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_SEPARATORS = _ENDS | np.isin(np.arange(256), list(BLANKS))

Renamed = dict[int, dict[str, int]]


def _ids(words: Words, names: list[str], row: np.ndarray, renamed: Renamed, bits: int) -> np.ndarray:
    """A number of so many bits for each word and its language."""
    salt = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in names], dtype=np.uint64)
    ids = mix(words.hash ^ salt[row]) >> np.uint64(64 - bits)
    if renamed:
        for i in np.flatnonzero(np.isin(ids, np.array(list(renamed), dtype=np.uint64))):
            spelled = names[row[i]] + "\t" + words.raw[words.start[i] : words.end[i]].tobytes().decode()
            ids[i] = renamed[int(ids[i])].get(spelled, int(ids[i]))
    return ids


def _block(part: pa.RecordBatch, text: str, lang: str, renamed: Renamed, bits: int = 64) -> tuple[list, list, list, bytes] | None:
    """(ids, list lengths, spellings, positions) of the words of some documents, by ascending id; a spelling is language,
    tab and word."""
    words = Words(column(part, text), _SEPARATORS)
    n = len(words)
    if not n:
        return None
    names = ["und" if x is None else x for x in column(part, lang).to_pylist()]
    row = np.repeat(np.arange(part.num_rows), np.diff(words.bounds))
    ids = _ids(words, names, row, renamed, bits)
    ends = np.zeros(len(words.raw) + 1, dtype=np.int32)
    np.cumsum(_ENDS[words.raw], out=ends[1:])
    apart = (row[1:] != row[:-1]) | (ends[words.start[1:]] != ends[words.end[:-1]])
    position = np.arange(n, dtype=np.int32)
    position[1:] += np.cumsum(apart, dtype=np.int32)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    sizes = np.diff(np.append(heads, n))
    # every occurrence must have the spelling of its list
    start, length, first = words.start[order], (words.end - words.start)[order], np.repeat(heads, sizes)
    code = {x: i for i, x in enumerate(dict.fromkeys(names))}
    of = np.array([code[x] for x in names])[row[order]]
    odd = (length != length[first]) | (of != of[first])
    for i in range(0, n, SLICE):  # by slices, so that the places of bytes need little room
        even = i + np.flatnonzero(~odd[i : i + SLICE])
        differ = words.raw[gather(start[even], length[even])] != words.raw[gather(start[first[even]], length[even])]
        if differ.any():
            odd[even[np.searchsorted(np.cumsum(length[even]), np.flatnonzero(differ), side="right")]] = True
    spell = lambda i: names[row[order[i]]] + "\t" + words.raw[start[i] : start[i] + length[i]].tobytes().decode()
    spelled = [spell(i) for i in heads]
    more = sorted({(int(ids[i]), spell(i)) for i in np.flatnonzero(odd)})  # words with the number of another one
    numbers = [*ids[heads].view(np.int64).tolist(), *np.array([i for i, _ in more], dtype=np.uint64).view(np.int64).tolist()]
    return numbers, [*sizes.tolist(), *[0] * len(more)], [*spelled, *[s for _, s in more]], position[order].astype("<i4").tobytes()


def _index(docs: DataFrame, text: str, lang: str, renamed: Renamed, bits: int) -> DataFrame:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, text, BLOCK):
            row = _block(part, text, lang, renamed, bits)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["ids", "sizes", "spelled", "positions"])

    return docs.select(text, lang).mapInArrow(run, "ids array<bigint>, sizes array<int>, spelled array<string>, positions binary")


def build_index(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The index (a row per block) and the vocabulary (phrase, spelled, f), both written; numbers are unique to words,
    which are hashed to ``bits`` bits at first."""
    renamed: Renamed = {}
    while True:
        index = cut(_index(docs, text, lang, renamed, bits), "postings", arrow_rows=TEXTS, file_rows=BLOCKS)
        each = index.select(F.inline(F.arrays_zip("ids", "sizes", "spelled")))
        words = cut(each.groupBy("ids", "spelled").agg(F.sum("sizes").alias("f")), "words")
        shared = words.groupBy("ids").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
        clashes = words.join(shared, "ids", "left_semi").select("ids", "spelled").limit(CLASHES + 1).collect()
        if not clashes:
            vocabulary = words.select(F.unhex(F.lpad(F.hex("ids"), 16, "0")).alias("phrase"), "spelled", "f")
            vocabulary._tessera_path = words._tessera_path  # for discard
            return index, vocabulary
        if len(clashes) > CLASHES:
            raise ValueError("too many words share a number")
        for r in clashes:
            number = int.from_bytes(hashlib.sha256(f"{len(renamed)}\t{r.spelled}".encode()).digest()[:8], "big")
            renamed.setdefault(r.ids % (1 << 64), {})[r.spelled] = number
        discard(index)
        discard(words)


def _slots(phrases: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each phrase (a row of numbers) in a filter of ``bits`` bits."""
    h = np.zeros(len(phrases), dtype=np.uint64)
    for k in range(phrases.shape[1]):
        h = mix(h + phrases[:, k])
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """Bits of a set of phrases, of bounded size; ``holds`` is true for all of them and for few others."""

    def __init__(self, phrases: DataFrame, words: int):
        """``phrases``: a column phrase of ``words`` 8-byte numbers each."""
        spark, n = phrases.sparkSession, phrases.count()
        self.bits = bits = 1 << min(FILTER_BITS, max(16, (16 * n).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = np.concatenate(_slots(_numbers(batch.column(0), words), bits))
                yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array((np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64))], ["at", "bit"])

        set_ = phrases.select("phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        held = np.zeros(bits >> 6, dtype=np.int64)
        held[set_["at"].to_numpy()] = set_["bits"].to_numpy()
        self.sent = spark.sparkContext.broadcast(held.view(np.uint64).tobytes())

    def holds(self, phrases: np.ndarray) -> np.ndarray:
        held = np.frombuffer(self.sent.value, dtype=np.uint64)
        a, b = _slots(phrases, self.bits)
        test = lambda x: held[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1)
        return (test(a) & test(b)).astype(bool)


def _numbers(phrases: pa.Array, words: int) -> np.ndarray:
    """The numbers of phrases, a row each."""
    data = b"".join(x.as_py() for x in phrases)
    return np.frombuffer(data, dtype=">u8").astype(np.uint64).reshape(-1, words)


def extend(ids: np.ndarray, sizes: np.ndarray, positions: np.ndarray, filters: list) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``len(filters) + 1`` words of a block (a row of numbers each) and the lengths of their lists.

    ``filters[k]`` tells which phrases of k + 1 words are worth extending.
    """
    name = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    kept = filters[0].holds(ids[:, None])[name]
    name, place = name[kept], positions[kept]
    in_order = np.argsort(place, kind="stable")
    posting_place, posting_name = place[in_order], name[in_order]  # all postings by position
    del kept, in_order
    name, place = posting_name, posting_place  # occurrences by position: the words themselves at first
    phrases, counts = ids[:, None], sizes
    for k, passes in enumerate(filters, 1):
        if k > 1:
            on = passes.holds(phrases)[name]
            name, place = name[on], place[on]
        # both sides ascend: each occurrence meets the posting k places on, if there is one
        at = np.searchsorted(posting_place, place + k)
        hit = at < len(posting_place)
        hit[hit] = posting_place[at[hit]] == place[hit] + k
        longer = name[hit].astype(np.int64) * len(ids) + posting_name[at[hit]]
        place = place[hit]
        lists, name, counts = np.unique(longer, return_inverse=True, return_counts=True)
        phrases = np.concatenate((phrases[lists // len(ids)], ids[lists % len(ids)][:, None]), axis=1)
        if k > 1:
            on = passes.holds(phrases[:, 1:])  # its end must be frequent too
            name, place, counts, phrases = np.where(on, np.cumsum(on) - 1, -1)[name], place, counts[on], phrases[on]
            name, place = name[name >= 0], place[name >= 0]
    return phrases, counts


def _passed(phrases: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases and their counts in batches of PASSED rows: an executor holds a batch whole, beside its heap."""
    width = 8 * phrases.shape[1]
    for i in range(0, len(counts), PASSED):
        some, n = phrases[i : i + PASSED], counts[i : i + PASSED]
        data = pa.py_buffer(some.astype(">u8").tobytes())
        ends = pa.py_buffer(np.arange(0, width * (len(n) + 1), width, dtype=np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(n), [None, ends, data]), pa.array(n, pa.int64())], ["phrase", "n"])


def _level(index: DataFrame, filters: list[Filter], least: int) -> DataFrame:
    """(phrase, f) of the phrases of one word more than there are filters, with their exact frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, positions in zip(*(batch.column(i) for i in range(3))):
                sizes, positions = np.asarray(sizes.values, dtype=np.int64), np.frombuffer(positions.as_py(), dtype="<i4")
                phrases, counts = extend(np.asarray(ids.values).view(np.uint64), sizes, positions, filters)
                yield from _passed(phrases, counts)
                del phrases, counts, sizes, positions
                give_back()

    found = index.select("ids", "sizes", "positions").mapInArrow(run, "phrase binary, n long")
    return cut(found.groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases", arrow_rows=1)


#: floor(1000000 a a / (l r)), exactly: 38 digits hold the products.
SCORE = "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (phrase, a) with lang and the l, r and score of their weakest cut; ``counts`` has part, f, lang (of words)."""
    words = (F.octet_length("phrase") / 8).cast("int")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), words - 1), lambda i: F.array(
        F.struct(i.alias("cut"), F.lit(True).alias("head"), F.substring("phrase", F.lit(1), 8 * i).alias("part")),
        F.struct(i.alias("cut"), F.lit(False).alias("head"), F.substring("phrase", 8 * i + 1, 8 * (words - i)).alias("part")),
    )))
    parts = candidates.select("phrase", "a", F.inline(cuts))
    both = salted_join(parts, counts, "part", few=FEW).groupBy("phrase", "a", "cut").agg(
        F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"), F.max(F.when(F.col("head") & (F.col("cut") == 1), F.col("lang"))).alias("lang"))
    weakest = both.withColumn("score", F.expr(SCORE)).groupBy("phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_w"), F.max("lang").alias("lang"))
    return weakest.select("lang", "phrase", "a", "_w.l", "_w.r", "_w.score")


def _covered(levels: list[DataFrame]) -> DataFrame | None:
    """(phrase, most): the frequency of the most frequent longer candidate that a phrase stands in."""
    inner = None
    for k, level in enumerate(levels[1:], 3):
        places = [(i, m) for m in range(2, k) for i in range(k - m + 1)]
        each = level.select(F.explode(F.array(*[F.substring("phrase", 8 * i + 1, 8 * m) for i, m in places])).alias("phrase"), F.col("f").alias("most"))
        inner = each if inner is None else inner.unionByName(each)
    return None if inner is None else inner.groupBy("phrase").agg(F.max("most").alias("most"))


def _spelled(phrases: DataFrame, named: DataFrame) -> DataFrame:
    """Phrases with ``spelling``: their words with single spaces."""
    each = phrases.select("phrase", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("phrase") / 8).cast("int") - 1), lambda i: F.substring("phrase", 8 * i + 1, F.lit(8)))).alias("at", "part"))
    words = salted_join(each, named.select(F.col("phrase").alias("part"), "word"), "part", few=FEW)
    whole = words.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("spelling"))
    return phrases.join(whole, "phrase")


#: A candidate's place, most significant digit first: by score, then by frequency.
DIGITS = {"d1": "score div 1000", "d2": "score % 1000", "d3": "least(a, 99999)"}


def _borders(scored: DataFrame, top: int) -> DataFrame:
    """(lang, b1, b2, b3): the digits of each language's ``top``-th candidate, for languages with as many. Digit by digit
    the candidates that agree so far are counted; a count has at most a thousand digits, or a hundred thousand
    frequencies, whatever the number of candidates."""
    ranked = scored.selectExpr("lang", *[f"{x} AS {d}" for d, x in DIGITS.items()])
    border, known = None, []
    for d in DIGITS:
        same = ranked.withColumn("above", F.lit(0).cast("long"))
        if known:
            same = salted_join(ranked, border, "lang", few=FEW).where(" AND ".join(f"d{b[1:]} = {b}" for b in known))
        counts = same.groupBy("lang", "above", *known, d).agg(F.count("*").alias("k"))
        run = F.col("above") + F.sum("k").over(Window.partitionBy("lang").orderBy(F.col(d).desc()))
        reached = counts.withColumn("run", run).where(F.col("run") >= top)
        last, b = border, f"b{d[1:]}"
        border = cut(reached.groupBy("lang").agg(F.max(F.struct(F.col(d).alias(b), (F.col("run") - F.col("k")).alias("above"), *known)).alias("_b")).select("lang", "_b.*"), "border")
        known.append(b)
        if last is not None:
            discard(last)
    return border.drop("above")


def _beyond(scored: DataFrame, borders: DataFrame) -> DataFrame:
    """Candidates that are at or beyond the border of their language, if it has one."""
    place, border = F.struct(*[F.expr(x) for x in DIGITS.values()]), F.struct("b1", "b2", "b3")
    return salted_join(scored, borders, "lang", how="left", few=FEW).where(F.col("b1").isNull() | (place >= border)).drop("b1", "b2", "b3")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, overlap: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that occur
    ``least`` times at least.

    a, l and r are the frequencies of the phrase and of the two parts at its weakest cut, n all words of the language.
    Phrases that stand in a longer candidate in ``overlap`` of 100 occurrences or more are dropped.
    """
    index, vocabulary = build_index(docs, text, lang)
    word = F.call_function("substring_index", "spelled", F.lit("\t"), F.lit(-1))
    named = vocabulary.select("phrase", "f", word.alias("word"), F.expr("substring(spelled, 1, length(spelled) - length(substring_index(spelled, '\t', -1)) - 1)").alias("lang"))
    totals = cut(named.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    named = named.where(F.col("f") >= least)
    levels, filters = [], [Filter(named, 1)]
    for k in range(2, longest + 1):
        levels.append(_level(index, filters, least))
        if k < longest:
            filters.append(Filter(levels[-1], k))
    discard(index)
    candidates = levels[0]
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    counts = named.select(F.col("phrase").alias("part"), "f", "lang")
    for level in levels[:-1]:
        counts = counts.unionByName(level.select(F.col("phrase").alias("part"), "f", F.lit(None).cast("string").alias("lang")))
    candidates = candidates.withColumnRenamed("f", "a")
    covered = _covered(levels)
    if covered is not None:
        candidates = candidates.join(covered, "phrase", "left").where(f"most IS NULL OR 100 * most < {overlap} * a").drop("most")
    # both are counted and joined several times, but made once
    candidates = cut(candidates, "candidates")
    scored = cut(_scored(candidates, counts), "scored")
    discard(candidates)
    last = _borders(scored, top)
    rest = cut(_beyond(scored, last), "rest")
    discard(scored)
    with setting(scored.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold", str(top)):  # each task sends its best ones only
        ranked = salted_join(_spelled(rest, named), totals, "lang", rest, few=FEW)
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("spelling"))
        best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = cut(best.select("lang", F.col("rank").cast("long").alias("rank"), F.col("spelling").alias("phrase"), "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "collocations")
    for table in (*levels, rest, last, totals, vocabulary):
        discard(table)
    return out


def oracle(longest: int = 3, least: int = 10, top: int = 2000, overlap: int = 50) -> str:
    """DuckDB SQL for ``collocations`` over documents."""
    lengths = ", ".join(f"({k})" for k in range(1, longest + 1))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ws FROM w, (VALUES {lengths}) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, ws, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, ws, f AS a FROM f WHERE k > 1 AND f >= {least}),
inside AS (SELECT lang, k, a, unnest(list_transform(range(0, k * k), lambda j: ws[1 + j % k:1 + j // k])) AS ws FROM c WHERE k > 2),
longer AS (SELECT lang, ws, max(a) AS most FROM inside WHERE len(ws) > 1 AND len(ws) < k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, ws) WHERE most IS NULL OR 100 * most < {overlap} * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
s AS (SELECT cuts.lang, cuts.ws, cut, a, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ws = cuts.ws[1:cut] JOIN f y ON y.lang = cuts.lang AND y.ws = cuts.ws[cut + 1:]),
weakest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM weakest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
