"""N-gram Jaccard join: a size-aware heavy-light join on sets of word shingles.

Documents with equal sets form a class, and only classes are joined. A boundary on the set size, chosen
by cost, splits them:

* small sets enumerate subsets: two sets of sizes n <= m link exactly when they share c(n, m) elements,
  so each emits, for every partner size, its subsets of that fixed size; a class of the smaller size n is
  linked with all that have a common subset with it, without looking at the texts. Two of the larger size m
  share too little by that, they are linked by the subsets for (m, m);
* large sets are entered into inverted lists, by their prefix in one global order (an overlap of c needs
  a common element among the first n - c + 1). Heavy shingles, found by a count over all documents, come
  last in the order, so common passages don't make long lists.

A list's centre is its member with the fewest light shingles, hence the base of a group of near copies.
Every member is first compared with the best of its lists' centres, then with those centres that are
still in another component. What can be left are links between members of a list that are in different
components. One of the two, x, then isn't linked with the centre c. Let D(x) be the shingles in which x and c
differ, and most(n, m) the largest symmetric difference of linked sets of these sizes. Two linked members
share at least t = (|D(x)| + |D(y)| - most) / 2 of their differences, and t > 0 if x isn't linked with c. If
they have a light shingle in common, they also meet in its list, as all light ones of both are in their
prefixes; else the shared differences are among the others. So in lists of more than SHORT members only
those meet again that have an element in common in the prefixes of these differences. In the order of a centre's
differences those that many of its members share come last, the commonest at the end, so that a whole family's
differences from the centre fall out of the prefixes and what is left is a member's own. Members that are in one
component already don't meet. A group of copies with edits of their own costs a star of links, not all pairs. In shorter lists the members meet each
other, if the places of the common shingle allow a link. Every pair is bounded by the histograms of its sets and verified exactly on its whole texts.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer than K
words are one shingle; rows that share an id are one document with several texts; a null id gets the
component of its class, null if the class has no other. Ids may be of any type that has an order. Columns
other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.batches import column, small
from tessera.llm.components import connected_components
from tessera.llm.skew import salted_join
from tessera.llm.store import cut, discard
from tessera.llm.words import Words, distinct_by_row, mix

K = 5
#: Similarity as a fraction: 4/5.
NUM, DEN = 4, 5
#: Subsets are enumerated up to this size at most: beyond it a set has thousands of them.
LARGEST_SMALL = 16
#: What an entry in an inverted list costs, with the comparisons it leads to, in rows of subsets.
LIST_COST = 8
#: A shingle that occurs this often is heavy; so many heavy ones at most, the most frequent, are broadcast (8
#: bytes each). Which ones are heavy affects only the order, so never the result.
HEAVY, MAX_HEAVY = 64, 500_000
#: Lists of shingles that occur this often are dealt in parts to several tasks; so many parts of a list and
#: so many such lists, the longest, at most.
PART, MAX_PARTS, MAX_DEALT = 2048, 4096, 50_000
#: In longer lists members meet by their differences from the centre.
SHORT = 32
#: Differences from a centre that so many prefixes hold, and more than one SHARE-th of all prefixes' elements, are common:
#: there are SHARE of them at most. Of their centres all differences are counted, and the MAX_COMMON commonest that so many
#: members have are moved to the end of the order, which changes which pairs are tested, never the result.
CROWD, SHARE, MAX_COMMON = 64, 10_000, 100_000
#: Texts of up to so many documents are picked by a broadcast of their ids before they are shuffled.
FEW_TEXTS = 200_000
#: Members that meet many others in one element are dealt in parts of so many, and by how many differences they have: each
#: band reaches BAND times as far as the one before.
MEETING_PART, BAND = 2048, 1.1
#: Pairs of texts in one Arrow batch, and bytes of either side that are split into sets at once.
PAIR_ROWS, PAIR_BYTES = 256, 1 << 20
#: Histogram bins of a set, 16 bits each; larger sets than LARGEST_BINNED are not bounded by them.
BINS, LARGEST_BINNED = 128, 65_535


def overlap(n: int, m: int) -> int:
    """The least intersection of linked sets of sizes n and m: ceil(s (n + m) / (1 + s))."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_length(n: int) -> int:
    """With the smallest partner, overlap is at least ceil(s n)."""
    return n - -(-NUM * n // DEN) + 1


def may_link(n: str, m: str, i: str, j: str) -> Column:
    """Whether sets of sizes n and m can link whose first common element is at places i and j.

    All common elements stand at or after these places, so n - i and m - j bound the overlap.
    """
    least = f"(({NUM} * ({n} + {m}) + {NUM + DEN - 1}) DIV {NUM + DEN})"
    return F.expr(f"least({n}, {m}) * {DEN} >= greatest({n}, {m}) * {NUM} AND {n} - {i} >= {least} AND {m} - {j} >= {least}")


def partner_sizes(n: int) -> list[int]:
    return [m for m in range(-(-NUM * n // DEN), DEN * n // NUM + 1) if overlap(n, m) <= min(n, m)]


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which subsets are enumerated, chosen by cost: ``sizes`` has the number of sets by size.

    With boundary b, sets of size n <= b emit their subsets for partners up to b, and those that have a
    partner above b, entries in lists as well.
    """

    def cost(b: int) -> int:
        subsets = sum(c * sum(comb(n, overlap(n, m)) for m in partner_sizes(n) if m <= b) for n, c in sizes.items() if 0 < n <= b)
        return subsets + LIST_COST * sum(c * prefix_length(n) for n, c in sizes.items() if n > 0 and DEN * n // NUM > b)

    return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, rows = Words(texts).shingles(K)
    return distinct_by_row(values, rows, len(texts))


#: A task passes on what it saw once for this part of all shingles, so that those spread over many tasks are seen.
SLICE = 64
#: What such a sighting counts: two make a heavy shingle.
SIGHTING = HEAVY // 2


def count_shingles(docs: DataFrame, text: str = "text") -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """The number of texts by set size up to DEN/NUM of LARGEST_SMALL, the sorted hashes of the heavy shingles and
    about how often each occurs.

    Each task counts what it reads and passes on what it saw several times, and, of one SLICE of all
    shingles, what it saw once; what is shuffled is a small part of all shingles. A shingle that is never
    seen twice in a task may be missed; as heaviness only orders the shingles, that costs a longer list.
    """
    bound = DEN * LARGEST_SMALL // NUM

    def run(batches):
        held: list[np.ndarray] = []
        slot = np.uint64(TaskContext.get().partitionId() % SLICE)
        sizes = np.zeros(bound + 1, dtype=np.int64)

        def count():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            once = (times == 1) & (values % np.uint64(SLICE) == slot)
            keep = (times > 1) | once
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(np.where(once, SIGHTING, times)[keep]), pa.array(np.zeros(int(keep.sum()), bool))], ["h", "c", "size"])

        for part in small(batches, text):
            values, bounds = _sets(column(part, text))
            n = np.diff(bounds)
            sizes += np.bincount(n[n <= bound], minlength=bound + 1)
            held.append(values)
            if sum(map(len, held)) > 2_000_000:  # 16 MB
                yield count()
        if held:
            yield count()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bound + 1)), pa.array(sizes), pa.array(np.ones(bound + 1, bool))], ["h", "c", "size"])

    counts = docs.select(text).mapInArrow(run, "h long, c long, size boolean").groupBy("size", "h").agg(F.sum("c").alias("c"))
    counts = cut(counts.where(F.col("size") | (F.col("c") >= HEAVY)), "shingles")
    sizes = {r.h: r.c for r in counts.where("size").collect()}
    # the most frequent ones by steps of the count, so that no more than MAX_HEAVY rows come to the driver
    step = F.floor(F.log2("c") * 8)
    held, least = 0, 0
    for r in counts.where("NOT size").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > MAX_HEAVY:
            least = r.step + 1
            break
    rows = counts.where(~F.col("size") & (step >= least)).select("h", "c").toPandas()
    discard(counts)
    h, c = rows.h.to_numpy(np.int64).view(np.uint64), rows.c.to_numpy(np.int64)
    order = np.argsort(h)
    return sizes, h[order], c[order]


def _class_keys(values: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """128 hash bits of each row's set, as two longs: sums of its mixed elements."""
    sums = (np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x5BD1E995, 0x1B873593))
    return [pa.array((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64)) for x in sums]


SIGNED = "n int, k1 long, k2 long"


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, n, k1, k2): the size of a document's set and 128 hash bits of it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in small(batches, text):
            values, bounds = _sets(column(part, text))
            yield pa.RecordBatch.from_arrays([column(part, key), pa.array(np.diff(bounds).astype(np.int32)), *_class_keys(values, bounds)], ["_id", "n", "k1", "k2"])

    return docs.select(key, text).mapInArrow(run, f"_id {kind}, {SIGNED}")


def _entries(docs: DataFrame, heavy, most: int, key: str, text: str) -> DataFrame:
    """(_id, n, k1, k2, light, tokens, sure, sketch) of each document: its list entries and subsets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        last = heavy.value
        for part in small(batches, text):
            values, bounds = _sets(column(part, text))
            at = np.minimum(np.searchsorted(last, values), max(len(last) - 1, 0))
            weighty = last[at] == values if len(last) else np.zeros(len(values), dtype=bool)
            light, tokens, sure, sketch = [], [], [], []
            for i in range(part.num_rows):
                v, w = values[bounds[i] : bounds[i + 1]], weighty[bounds[i] : bounds[i + 1]]
                n = len(v)
                light.append(n - int(w.sum()))
                sketch.append(np.bincount((v >> np.uint64(57)).astype(np.int64), minlength=BINS).clip(max=LARGEST_BINNED).astype("<u2").tobytes())
                listed, subsets = v[:0], v[:0]
                if n and DEN * n // NUM > most:
                    listed = np.concatenate((v[~w], v[w]))[: prefix_length(n)]
                if n and n <= most:
                    subsets = _subsets(v, most)
                tokens.append(listed.tobytes())
                sure.append(subsets.tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(part, key), pa.array(np.diff(bounds).astype(np.int32)), *_class_keys(values, bounds), pa.array(light, pa.int32()), pa.array(tokens, pa.binary()), pa.array(sure, pa.binary()), pa.array(sketch, pa.binary())],
                ["_id", "n", "k1", "k2", "light", "tokens", "sure", "sketch"],
            )

    return docs.select(key, text).mapInArrow(run, f"_id {kind}, {SIGNED}, light int, tokens binary, sure binary, sketch binary")


def _subsets(v: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the fixed-size subsets of a small set, for each partner size up to ``most``.

    The last bit says whether both sizes are the same, so whether any two sets with the subset link.
    """
    n, out = len(v), []
    for m in partner_sizes(n):
        if m <= most:
            low, high, c = min(n, m), max(n, m), overlap(n, m)
            which = np.array(list(combinations(range(n), c)))
            hashed = mix(mix(v)[which].sum(axis=1, dtype=np.uint64) + np.uint64((low << 16) + high))
            out.append(hashed & ~np.uint64(1) | np.uint64(low == high))
    return np.unique(np.concatenate(out)) if out else v[:0]


LISTED = "token long, sure boolean, id {id}, n int, pos int, light int, part int"
LISTS = "token long, sure boolean, id {id}, n int, pos int, light int, part int, centre {id}, weight int, centre_n int, centre_pos int"


def _explode(classes: DataFrame, hot) -> DataFrame:
    """LISTED: a row per entry; light is the size in rows of subsets, whose centre is thus of the smaller size.

    ``hot`` has the sorted tokens whose lists are dealt in parts, and how many parts; part is -1 for the others.
    """
    kind = classes.schema["id"].dataType.simpleString()

    def run(batches):
        tokens, parts = hot.value
        for part in batches:
            for name, sure in (("tokens", False), ("sure", True)):
                data = column(part, name)
                counts = np.asarray(pa.compute.binary_length(data), dtype=np.int64) // 8
                if counts.sum():
                    flat = np.frombuffer(b"".join(data.to_pylist()), dtype=np.int64)
                    again = lambda c: np.repeat(column(part, c).to_numpy(zero_copy_only=False), counts)  # noqa: B023, E731
                    place = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
                    at = np.minimum(np.searchsorted(tokens, flat.view(np.uint64)), max(len(tokens) - 1, 0))
                    split = (tokens[at] == flat.view(np.uint64)) & (not sure) if len(tokens) else np.zeros(len(flat), dtype=bool)
                    deal = np.repeat(mix(column(part, "k1").to_numpy().view(np.uint64)), counts)
                    dealt = np.where(split, deal % parts[at].astype(np.uint64), 0).astype(np.int32) - ~split if len(tokens) else np.full(len(flat), -1, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.full(len(flat), sure)), pa.array(again("id")), pa.array(again("n")), pa.array(place), pa.array(again("n" if sure else "light")), pa.array(dealt.astype(np.int32))], ["token", "sure", "id", "n", "pos", "light", "part"])

    return classes.select("id", "n", "k1", "light", "tokens", "sure").mapInArrow(run, LISTED.format(id=kind))


def _lists(entries: DataFrame) -> DataFrame:
    """LISTS: the rows of the lists with several members, with their centre's id, number of light shingles
    (weight), size and place, by a scan over sorted entries.

    Nothing but the current list's centre is held, so a list may be of any length. Each part of a dealt list
    has its own centre at first.
    """
    kind = entries.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in LISTS.split(", ")]

    def run(batches):
        last = None  # token, sure, part and the centre's values of the current list
        waiting = None  # a list's only row so far
        for batch in batches:
            if not batch.num_rows:
                continue
            which = [column(batch, "token").to_numpy(), np.asarray(column(batch, "sure").to_numpy(zero_copy_only=False), dtype=bool), column(batch, "part").to_numpy()]
            row = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "n", "pos", "light", "part")]
            head = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "light", "n", "pos")]
            starts = np.ones(batch.num_rows, dtype=bool)
            starts[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in which])
            goes_on = last is not None and all(x[0] == y for x, y in zip(which, last[:3]))
            begin = np.flatnonzero(starts)
            run_of = np.cumsum(starts) - 1
            centre = [x[begin][run_of] for x in head]
            sizes = np.diff(np.concatenate((begin, [batch.num_rows])))
            several = (sizes > 1)[run_of] | (which[2] >= 0)
            out = []
            if goes_on:
                centre = [np.where(run_of == 0, old, x) for x, old in zip(centre, last[3:])]
                several |= run_of == 0
                if waiting is not None:
                    out.append(waiting)
            waiting = None
            i = batch.num_rows - 1
            if sizes[-1] == 1 and not several[i]:
                waiting = tuple(x[i:] for x in (which[0], which[1], *row, *head))
            last = (*[x[-1] for x in which], *[x[-1] for x in centre])
            out.append(tuple(x[several] for x in (which[0], which[1], *row, *centre)))
            arrays = [np.concatenate(x) for x in zip(*out)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    by_token = entries.repartition("token", "part").sortWithinPartitions("token", "sure", "part", "light", "id")
    return by_token.mapInArrow(run, LISTS.format(id=kind))


def _with_centres(lists: DataFrame) -> DataFrame:
    """Give all parts of a dealt list the best of their centres; there are at most MAX_DEALT such lists."""
    names = [x.split()[0] for x in LISTS.split(", ")]
    dealt = lists.where("part >= 0")
    best = dealt.groupBy("token").agg(F.min_by(F.struct("centre", "weight", "centre_n", "centre_pos"), F.struct("weight", "centre")).alias("_c"))
    merged = dealt.select("token", "sure", "id", "n", "pos", "light", "part").join(F.broadcast(best), "token").select("token", "sure", "id", "n", "pos", "light", "part", "_c.*")
    return lists.where("part < 0").select(*names).union(merged.select(*names))


def _bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, possible) of the pairs: whether they can link. The sum of the minima of two histograms' bins bounds
    the overlap."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))

    def run(batches):
        for part in batches:
            if part.num_rows:
                bins = [np.frombuffer(b"".join(column(part, c).to_pylist()), dtype="<u2").reshape(-1, BINS) for c in ("_s", "_t")]
                most = np.minimum(*bins).sum(axis=1, dtype=np.int64)
                n, m = column(part, "_n").to_numpy().astype(np.int64), column(part, "_m").to_numpy().astype(np.int64)
                possible = ((NUM + DEN) * most >= NUM * (n + m)) | (np.maximum(n, m) > LARGEST_BINNED)
                possible &= np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM
                yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b"), pa.array(possible)], ["a", "b", "possible"])

    joined = salted_join(pairs.join(one, "a"), two, "b", pairs)
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "_n", "_s", "_m", "_t").mapInArrow(run, f"a {kind}, b {kind}, possible boolean")


def _with_texts(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add _x and _y, the texts of a and of b. Rows of one b come together, those of a frequent b in several parts."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    first = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_x")), "a")
    return salted_join(first, texts.select(F.col("_id").alias("b"), F.col("_text").alias("_y")), "b", pairs)


def _set_pairs(part: pa.RecordBatch):
    """The two sets of each row; that of equal texts _y in a row is made once."""
    firsts, at = _sets(column(part, "_x"))
    y = column(part, "_y")
    other = np.asarray(pa.compute.not_equal(y.slice(1), y.slice(0, len(y) - 1)).to_numpy(zero_copy_only=False), dtype=bool)
    starts = np.flatnonzero(np.concatenate(([True], other)))
    seconds, where = _sets(y.take(pa.array(starts)))
    run_of = np.searchsorted(starts, np.arange(len(y)), side="right") - 1
    for i in range(len(y)):
        yield firsts[at[i] : at[i + 1]], seconds[where[run_of[i]] : where[run_of[i] + 1]]


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The linked ones among pairs (a, b) of documents: what their whole texts give."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for part in small(small(batches, "_x", PAIR_BYTES), "_y", PAIR_BYTES):
            linked = []
            for v, w in _set_pairs(part):
                common = len(np.intersect1d(v, w, assume_unique=True))
                linked.append(bool(len(v) and len(w) and DEN * common >= NUM * (len(v) + len(w) - common)))
            yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return _with_texts(pairs, docs, key, text).select("a", "b", "_x", "_y").mapInArrow(run, f"a {kind}, b {kind}")


def most_apart(n, m):
    """The largest symmetric difference of linked sets of sizes n and m."""
    return n + m - 2 * overlap(n, m)


def shared_differences(d: int, m: int, k: int) -> int:
    """How many of its d differences from a centre of size k a set of size m shares at least with any set that it is
    linked with and that isn't linked with the centre.

    That set, of size n, has more than most_apart(n, k) differences, hence two more at least, as all symmetric
    differences of sets of these sizes are odd or all are even. The bound depends on n modulo NUM + DEN.
    """
    n = -(-NUM * m // DEN)
    least = min(most_apart(i, k) - most_apart(i, m) for i in range(n, n + NUM + DEN))
    return max(1, -(-(d + 2 + least) // 2))


#: Marks what only the centre has.
LACKS = 0xA0761D6478BD642F
DIFFERENCES = "centre {id}, token long, far boolean, both boolean, id {id}, n int, left int, d int, label {id}, home {id}"


def _differences(members: DataFrame, heavy, docs: DataFrame, key: str, text: str, common=None) -> DataFrame:
    """DIFFERENCES: prefixes of the differences of list members (a, b, label, far, light) from their centres (b).

    The order is: light elements that only the member has (if they meet in the list of a light one), heavy
    ones, those that only the centre has; and after all others those that ``common`` names, a broadcast of {centre: (sorted
    elements, counts)}, by their counts. The prefix for far partners, which aren't linked with the centre, is marked (both); a
    far member has a longer one for near partners.
    """
    kind = members.schema["a"].dataType.simpleString()
    lacks = np.uint64(LACKS)

    def run(batches):
        last, crowds = heavy.value, common.value if common else {}
        for part in small(small(batches, "_x", PAIR_BYTES), "_y", PAIR_BYTES):
            centres = column(part, "b").to_pylist() if crowds else []
            far, lights = (np.asarray(column(part, c).to_numpy(zero_copy_only=False), dtype=bool) for c in ("far", "light"))
            rows, tokens, both, left, count, size = [], [], [], [], [], []
            for i, (v, w) in enumerate(_set_pairs(part)):
                own, gone = np.setdiff1d(v, w, assume_unique=True), np.setdiff1d(w, v, assume_unique=True)
                at = np.minimum(np.searchsorted(last, own), max(len(last) - 1, 0))
                weighty = last[at] == own if len(last) else np.zeros(len(own), dtype=bool)
                order = np.concatenate((own[~weighty] if lights[i] else own[:0], own[weighty], mix(gone ^ lacks)))
                if crowds and centres[i] in crowds and len(order):
                    named, counts = crowds[centres[i]]
                    place = np.minimum(np.searchsorted(named, order), len(named) - 1)
                    order = order[np.argsort(np.where(named[place] == order, counts[place], 0), kind="stable")]
                d, n, m = len(own) + len(gone), len(v), len(order)
                if not m or not n:
                    continue
                # a partner has at least as many differences as are shared, and is at most n / 4 away from the set
                whole = max(0, m - max(1, d - n // NUM) + 1)
                with_far = max(0, min(whole, m - shared_differences(d, n, len(w)) + 1))
                length = whole if far[i] else with_far
                rows += [i] * length
                tokens.append(order[:length])
                both += [True] * with_far + [False] * (length - with_far)
                left += range(m, m - length, -1)
                count += [d] * length
                size += [n] * length
            if rows:
                again = lambda c: column(part, c).take(pa.array(rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [again("b"), pa.array(np.concatenate(tokens).view(np.int64)), again("far"), pa.array(both), again("a"), pa.array(size, pa.int32()), pa.array(left, pa.int32()), pa.array(count, pa.int32()), again("label"), again("home")],
                    ["centre", "token", "far", "both", "id", "n", "left", "d", "label", "home"],
                )

    return _with_texts(members, docs, key, text).select("a", "b", "label", "far", "light", "home", "_x", "_y").mapInArrow(run, DIFFERENCES.format(id=kind))


#: most_apart in SQL, of x_n and y_n.
APART = f"(x_n + y_n - 2 * (({NUM} * (x_n + y_n) + {NUM + DEN - 1}) DIV {NUM + DEN}))"


def _common(members: DataFrame, least: int, docs: DataFrame, key: str, text: str) -> dict:
    """{centre: (sorted elements, counts)} of the differences that more than ``least`` of the members (a, b) of a centre have."""
    kind = members.schema["b"].dataType
    lacks = np.uint64(LACKS)

    def run(batches):
        for part in small(small(batches, "_x", PAIR_BYTES), "_y", PAIR_BYTES):
            found: dict = {}
            for c, (v, w) in zip(column(part, "b").to_pylist(), _set_pairs(part)):
                found.setdefault(c, []).append(np.concatenate((np.setdiff1d(v, w, assume_unique=True), mix(np.setdiff1d(w, v, assume_unique=True) ^ lacks))))
            for c, tokens in found.items():
                names, counts = np.unique(np.concatenate(tokens), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(names), column(part, "b").type), pa.array(names.view(np.int64)), pa.array(counts)], ["centre", "token", "n"])

    each = _with_texts(members, docs, key, text).select("a", "b", "_x", "_y").mapInArrow(run, f"centre {kind.simpleString()}, token long, n long")
    rows = each.groupBy("centre", "token").agg(F.sum("n").alias("n")).where(F.col("n") > least).orderBy(F.col("n").desc()).limit(MAX_COMMON).collect()
    listed: dict = {}
    for r in rows:
        listed.setdefault(r.centre, []).append((r.token, r.n))
    out = {}
    for c, pairs in listed.items():
        names = np.array([x for x, _ in pairs], dtype=np.int64).view(np.uint64)
        order = np.argsort(names)
        out[c] = names[order], np.array([n for _, n in pairs], dtype=np.int64)[order]
    return out


def _mixed(differences: DataFrame) -> DataFrame:
    """The written rows of ``differences`` whose element has a far member and members of several components, with _all, how many
    members it has."""
    every = Window.partitionBy("centre", "token")
    counted = differences.withColumns({"_all": F.count("*").over(every), "_a": F.min("label").over(every), "_b": F.max("label").over(every), "_some": F.max("far").over(every)})
    return cut(counted.where("_a < _b AND _some").drop("_a", "_b", "_some"), "mixed")


def _met(members: DataFrame, heavy, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The elements in which members (a, b, ..) can meet, as _mixed gives them; common ones come last in the order of their
    centre."""
    spark = docs.sparkSession
    differences = cut(_differences(members, heavy, docs, key, text), "differences", PAIR_ROWS)
    least = max(CROWD, differences.count() // SHARE)
    mixed = _mixed(differences)
    discard(differences)
    hot = [r.centre for r in mixed.where(F.col("_all") > least).select("centre").distinct().limit(SHARE).collect()]
    if not hot:
        return mixed
    crowded = F.broadcast(spark.createDataFrame([(c,) for c in hot], T.StructType([T.StructField("b", members.schema["b"].dataType)])))
    again = cut(members.join(crowded, "b", "left_semi").select(*members.columns), "crowded")
    ids = again.select(F.col("a").alias(key)).union(again.select("b")).distinct()
    few = docs.join(F.broadcast(ids), key, "left_semi").select(*docs.columns) if ids.count() <= FEW_TEXTS else docs
    common = spark.sparkContext.broadcast(_common(again, least, few, key, text))
    differences = cut(_differences(again, heavy, few, key, text, common), "differences", PAIR_ROWS)
    anew = _mixed(differences)
    others = mixed.join(crowded.withColumnRenamed("b", "centre"), "centre", "left_anti").select(*mixed.columns)
    out = cut(others.unionByName(anew), "mixed")
    for table in (mixed, again, differences, anew):
        discard(table)
    return out


#: What two members meet by.
MEETING = ["centre", "token", "_class", "_pair", "_part"]


def _sides(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of the meetings, keyed by MEETING.

    In an element of few members all meet. The members of a crowded one are of its most frequent component, or of others. Of the
    four classes of pairs that make three are needed, as two members of the most frequent component have nothing to tell
    each other. They meet by bands of their numbers of differences: the more a partner has, the more must be shared, so
    the earlier in the order the first shared one must be. The first side is dealt in parts, the second repeated
    for each.
    """
    values = [F.col(c) for c in ("far", "both", "id", "n", "left", "d", "label", "home")]
    side = lambda d, name: d.select(*MEETING, *[v.alias(f"{name}_{c}") for v, c in zip(values, ("far", "both", "id", "n", "left", "d", "label", "home"))])
    plain = mixed.where(F.col("_all") <= CROWD).withColumns({"_class": F.lit(0), "_pair": F.lit(-1), "_part": F.lit(0)})
    banded = mixed.where(F.col("_all") > CROWD).withColumn("_band", F.floor(F.log("d") / F.log(F.lit(BAND))).cast("int"))
    by_label = banded.groupBy("centre", "token", "label").agg(F.count("*").alias("_n"), F.collect_set("_band").alias("_bands"))
    keys = by_label.groupBy("centre", "token").agg(F.max_by("label", F.struct("_n", "label")).alias("_major"), F.array_distinct(F.flatten(F.collect_list("_bands"))).alias("_bands"))
    marked = banded.join(keys, ["centre", "token"]).withColumns({"_is": F.col("label") == F.col("_major"), "_parts": F.ceil(F.col("_all") / MEETING_PART).cast("int")})
    # partners are a quarter larger at most
    most = F.floor((F.col("n") + F.floor(F.col("n") * DEN / NUM)) / (NUM + DEN))
    open_ = F.filter("_bands", lambda j: 2 * F.col("left") >= F.col("d") + F.floor(F.pow(F.lit(BAND), j) - 1e-6) - most)
    met = marked.withColumn("_other", F.explode(open_))
    ids = F.pmod(F.xxhash64("id"), F.col("_parts").cast("long")).cast("int")
    pair = lambda own, other: 1000 * F.col(own) + F.col(other)
    # classes: 0 neither of the most frequent component, 1 the second, 2 the first
    x = met.where("far").withColumn("_class", F.explode(F.when(F.col("_is"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("_part", ids).withColumn("_pair", pair("_band", "_other"))
    y = met.withColumn("_class", F.explode(F.when(F.col("_is"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2))))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_pair", pair("_other", "_band"))
    return side(plain.where("far"), "x").unionByName(side(x, "x")), side(plain, "y").unionByName(side(y, "y"))


def _meetings(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs (a, b) of members whose differences from a centre can be those of linked sets; for members with the same
    home, from that one."""
    x, y = one.alias("x"), two.alias("y")
    fits = F.expr(
        f"(NOT y_far OR x_both AND y_both AND x_id < y_id) AND x_label <> y_label AND (x_home <> y_home OR x.centre = x_home) AND least(x_n, y_n) * {DEN} >= greatest(x_n, y_n) * {NUM}"
        f" AND 2 * least(x_left, y_left) >= x_d + y_d - {APART}"
    )
    for c in MEETING:
        fits = fits & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    found = x.join(y, fits)
    return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _placed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    one = found.select(F.col("node").alias("a"), F.col("component").alias("_l"))
    two = found.select(F.col("node").alias("b"), F.col("component").alias("_k"))
    out = pairs.join(one, "a", "left").join(two, "b", "left")
    return out.where(F.coalesce("_l", "a") != F.coalesce("_k", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the least id reachable by links) of every row."""
    context, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType.simpleString()
    docs = docs.select(key, text)
    sizes, heavy, often = count_shingles(docs, text)
    parts = np.minimum(often // PART, MAX_PARTS)
    longest = np.sort(np.argsort(-parts, kind="stable")[:MAX_DEALT])
    longest = longest[parts[longest] > 1]
    hot, heavy = context.broadcast((heavy[longest], parts[longest])), context.broadcast(heavy)

    # one row per class: copies collapse before the shuffle
    entries = _entries(docs, heavy, boundary(sizes), key, text).where("n > 0 AND _id IS NOT NULL")
    whole = entries.groupBy("n", "k1", "k2").agg(F.min("_id").alias("id"), *[F.first(c).alias(c) for c in ("light", "tokens", "sure", "sketch")])
    listed = cut(whole, "classes")
    scanned = cut(_lists(_explode(listed, hot)), "lists")
    whole = cut(listed.select("n", "k1", "k2", "id", "sketch"), "sketches")
    discard(listed)
    lists, sketches = _with_centres(scanned), whole.select("id", "n", "sketch")
    temporary = []

    def compared(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs."""
        pairs = cut(pairs, "pairs")
        bounded = cut(_bounded(pairs, sketches).where("possible").select("a", "b"), "bounded")
        links = cut(_verified(bounded, docs, key, text), "compared", PAIR_ROWS)
        discard(pairs)
        discard(bounded)
        temporary.append(links)
        return links

    star = lists.where("id <> centre")
    subsets = star.where("sure AND (centre_n < n OR (token & 1) = 1)").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    chosen = star.where("NOT sure").where(may_link("n", "centre_n", "pos", "centre_pos"))
    stars = cut(chosen.groupBy(F.col("id").alias("a"), F.col("centre").alias("b")).agg(F.min("weight").alias("weight")), "stars")
    best = cut(stars.groupBy("a").agg(F.min_by("b", F.struct("weight", "b")).alias("b")), "best")
    links = compared(best.union(subsets).distinct())
    found = connected_components(links)

    others = compared(_placed(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), found))
    if others.limit(1).count():
        links = links.union(others)
        found = connected_components(links)

    # what is left: members of a list, other than its centre, that are in different components
    place = lambda name, label: found.select(F.col("node").alias(name), F.col("component").alias(label))
    # those without a common light shingle are apart by their light ones, of which the centre has the fewest
    member = lists.where(f"NOT sure AND (id = centre OR pos < light OR light + weight <= n DIV {NUM})").select("token", "id", "n", "pos", "light", "centre").join(place("id", "_l"), "id", "left").withColumn("label", F.coalesce("_l", "id")).drop("_l")
    member = cut(member, "members")
    open_lists = member.groupBy("token").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count("*").alias("_c")).where("_x < _y").select("token", "_c")
    discard(scanned)
    rest = salted_join(member, open_lists, "token")
    rest = cut(rest.select("token", "id", "n", "pos", "light", "centre", "label", (F.col("_c") > SHORT).alias("long")), "rest")
    x, y = (rest.where("NOT long AND id <> centre").select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "pos", "light", "label")]) for side in "xy")
    open_ = (F.col("x_id") < F.col("y_id")) & (F.col("x_label") != F.col("y_label")) & may_link("x_n", "y_n", "x_pos", "y_pos")
    open_ = open_ & F.expr(f"x_pos < x_light OR y_pos < y_light OR x_light + y_light <= {APART}")
    late = x.join(y, (x.token == y.token) & open_).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
    members = rest.where("long").groupBy("centre", "id", "label").agg(F.max(F.col("pos") < F.col("light")).alias("light"), F.count("*").alias("_c"))
    members = cut(members, "centres")
    temporary.append(members)
    # members with the same home, the centre of most of their lists, need to meet there only
    homes = members.where("id <> centre").groupBy("id").agg(F.max_by("centre", F.struct("_c", "centre")).alias("home"))
    own = members.where("id = centre").select("centre", F.col("label").alias("_own"))
    members = salted_join(members, own, "centre").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), "label", "light", (F.col("label") != F.col("_own")).alias("far"))
    members = cut(members.join(homes.withColumnRenamed("id", "a"), "a"), "far")
    discard(member)
    # a centre without far members has nothing to add
    open_centres = members.where("far").select("b").distinct()
    open_members = cut(members.join(open_centres, "b", "left_semi").select(*members.columns), "open")
    mixed = _met(open_members, heavy, docs, key, text)
    one, two = _sides(mixed)
    more = compared(late.union(_meetings(one, two)).distinct())
    if more.limit(1).count():
        found = connected_components(links.union(more))
    for table in (*temporary, stars, best, rest, members, open_members, mixed):
        discard(table)

    named = whole.select("n", "k1", "k2", "id").join(found, F.col("id") == F.col("node"), "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("_component"))
    out = signatures(docs, key, text).join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_component"))
    return out.select(F.col("_id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are their component's least id, or have no id."""
    groups = near_duplicates(docs, key, text).where(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(groups, key, "left_anti").select(*docs.columns)
