"""LM scoring with Brown class-based bigrams.

Every token of the training documents is counted, and every word of them has a class. Exchange
clustering starts on the driver with the SEED most frequent ones, each moved, one at a time, to the class that
most raises the class-bigram likelihood; then distributed sweeps over the whole corpus move the NEAR most frequent words,
the first ones included: the classes before and after every word are counted, and each goes to the class
that is best for these counts, until next to nothing moves. All other words, the far ones, are placed by the same rule
once these classes are settled: the classes around each are gathered by word, and the best one is taken. A word's
emission within its class follows its own count.

Words that training never saw share one more class. Words seen once tell where it stands: each was unseen when it came, so
its transitions count once for its own class and once for this one, and so does its count. A text's score is the sum of
log10 class transition times word emission over its tokens and its end; its perplexity is 10 ** (-score / n_tokens).
With a bound CLASSED, only so many words have classes, and all others are in that last class with their own counts.

What is broadcast and what comes to the driver is bounded by NEAR (17 bytes each) and CLASSES**2. Counts and classes of the
far words stay in a table that is joined to the tokens; frequent words never reach that join, so its keys are not skewed.

Defined results: a null text is an empty text: one end token; rows that share an id are scored each;
a row with a null id is a training row; without training rows every count is 0. The end token counts as
a token of the training data whenever there are training rows. Columns other than the id and the text are not
looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import column, small
from tessera.llm.store import cut, discard
from tessera.llm.words import Words

SEED, NEAR, CLASSES = 1000, 60_000, 32
#: Words that have classes at most, the most frequent ones: None for all, else a number of words that can be broadcast.
CLASSED = None
#: Rarer words are never near.
LEAST_COUNT = 3
SWEEPS = 20
#: Distributed sweeps at most, and the part of the classed tokens that must move for another one.
PASSES, SETTLED = 3, 0.01
#: Additive weight of the class unigram in transitions.
BLEND = 2.0


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


def _index(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array, len(known) where absent."""
    if not len(known):
        return np.zeros(len(h), dtype=np.int64)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, at, len(known))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs, pre-aggregated in each task."""

    def run(batches):
        held: list[np.ndarray] = []

        def count():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], ["h", "c"])

        for part in small(batches, "text"):
            held.append(Words(column(part, "text")).hash)
            if sum(map(len, held)) > 4_000_000:
                yield count()
        if held:
            yield count()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _sequence(words: Words, states: np.ndarray, between: int) -> np.ndarray:
    """The states of a batch's words in order, with ``between`` before the first and after each text."""
    return np.insert(states, words.bounds[1:], between) if len(words.bounds) > 1 else states


def _pair_counts(texts: DataFrame, known, of, size: int) -> DataFrame:
    """(pair, c) with pair = previous * size + next over states of[place of word]; the last of the ``size``
    states stands for a text's start and end."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        counts = np.zeros(0, dtype=np.int64)
        for part in small(batches, "text"):
            words = Words(column(part, "text"))
            seq = np.concatenate(([size - 1], _sequence(words, of.value[_index(words.hash, known.value)], size - 1)))
            if len(seq) > 1:
                pairs, times = np.unique(seq[:-1] * size + seq[1:], return_counts=True)
                total, back = np.unique(np.concatenate((total, pairs)), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate((counts, times)), minlength=len(total)).astype(np.int64)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(counts)], ["pair", "c"])

    return texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word by the exchange algorithm.

    ``bigrams[v, w]`` counts w after v. The most frequent words open a class each, the others join the best
    one in order of frequency; then, in each sweep, every word is taken out of its class and put where
    the class-bigram log-likelihood is highest.
    """
    n = len(bigrams)
    classes = max(1, min(classes, n))
    of = np.full(n, -1)
    pairs = np.zeros((classes, classes))  # class bigram counts
    after, before = np.zeros((n, classes)), np.zeros((n, classes))  # word -> next classes, word -> previous classes

    def shift(w: int, c: int, sign: int) -> None:
        """Put a word into a class, or take it out."""
        nonlocal pairs
        if sign < 0:
            after[:, c] -= bigrams[:, w]
            before[:, c] -= bigrams[w]
        pairs[c] += sign * after[w]
        pairs[:, c] += sign * before[w]
        pairs[c, c] += sign * bigrams[w, w]
        if sign > 0:
            after[:, c] += bigrams[:, w]
            before[:, c] += bigrams[w]
        of[w] = c if sign > 0 else -1

    def gains(w: int) -> np.ndarray:
        """What each class gains in likelihood by the word, which is in none."""
        out, into, own = after[w], before[w], bigrams[w, w]
        base, diagonal, rows, columns = _xlogx(pairs), np.diagonal(pairs), pairs.sum(1), pairs.sum(0)
        gain = (_xlogx(pairs + out) - base).sum(1) + (_xlogx(pairs + into[:, None]) - base).sum(0)
        # the diagonal gets both and the word's own pairs
        gain += _xlogx(diagonal + out + into + own) - _xlogx(diagonal + out) - _xlogx(diagonal + into) + _xlogx(diagonal)
        # a row or column beside the word's own also changes its total
        left, right = rows + into, columns + out
        others_left, others_right = (_xlogx(left) - _xlogx(rows)).sum(), (_xlogx(right) - _xlogx(columns)).sum()
        gain -= others_left - (_xlogx(left) - _xlogx(rows)) + _xlogx(rows + into + out.sum() + own) - _xlogx(rows)
        gain -= others_right - (_xlogx(right) - _xlogx(columns)) + _xlogx(columns + out + into.sum() + own) - _xlogx(columns)
        return gain

    by_count = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    for rank, w in enumerate(by_count):
        shift(w, rank if rank < classes else int(np.argmax(gains(w))), 1)
    for _ in range(sweeps):
        moved = 0
        for w in by_count:
            old = int(of[w])
            shift(w, old, -1)
            gain = gains(w)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            shift(w, new, 1)
            moved += new != old
        if not moved:
            break
    return of


def _names(classes: int) -> list[str]:
    return [f"v{i}" for i in range(2 * classes)]


def _contexts(texts: DataFrame, known, of, classes: int) -> DataFrame:
    """place and 2 * classes counts for every word of ``known``: how often each class precedes and follows it. Words
    of no class (-1) count for no neighbour.

    A task adds up its own counts in one array and passes on one row per word; rows are summed by Spark.
    """
    names = _names(classes)

    def run(batches):
        size = len(known.value)
        total = np.zeros(size * 2 * classes, dtype=np.int32)
        state = np.append(of.value, [-1, -1])
        for part in small(batches, "text"):
            words = Words(column(part, "text"))
            place = _sequence(words, _index(words.hash, known.value), size)
            for w, c, offset in ((place[1:], state[place[:-1]], 0), (place[:-1], state[place[1:]], classes)):
                use = (w < size) & (c >= 0)
                at, times = np.unique(w[use] * 2 * classes + c[use] + offset, return_counts=True)
                total[at] += times.astype(np.int32)
        table = total.reshape(size, -1)
        used = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(used), 5000):
            rows = used[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(np.ascontiguousarray(table[rows, j])) for j in range(2 * classes)]], ["place", *names])

    counted = texts.mapInArrow(run, "place long, " + ", ".join(f"{n} int" for n in names))
    return counted.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])


def _matrix(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    return np.column_stack([column(batch, n).to_numpy() for n in _names(classes)]).astype(float)


def _class_pairs(contexts: DataFrame, of, classes: int) -> np.ndarray:
    """How often each class follows each, by the counts of all classed words."""

    def run(batches):
        total = np.zeros((classes, classes))
        for part in batches:
            if part.num_rows:
                own = of.value[column(part, "place").to_numpy()]
                np.add.at(total, own[own >= 0], _matrix(part, classes)[own >= 0, classes:])
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b].astype(np.int64))], ["a", "b", "c"])

    out = np.zeros((classes, classes))
    for x in contexts.mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).collect():
        out[x.a, x.b] = x.c
    return out


def _best_classes(contexts: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """(place, class): the class of highest likelihood for the neighbours of each word."""
    smooth = pairs + 0.5
    log_pairs, log_left, log_right = np.log(smooth), np.log(smooth.sum(axis=1)), np.log(smooth.sum(axis=0))

    def run(batches):
        for part in batches:
            if part.num_rows:
                v = _matrix(part, classes)
                before, after = v[:, :classes], v[:, classes:]
                # N(a, k) / N(k) for what precedes, N(k, b) / N(k) for what follows
                gain = before @ log_pairs + after @ log_pairs.T - before.sum(axis=1)[:, None] * log_right - after.sum(axis=1)[:, None] * log_left
                yield pa.RecordBatch.from_arrays([column(part, "place"), pa.array(gain.argmax(axis=1).astype(np.int32))], ["place", "class"])

    return contexts.mapInArrow(run, "place long, class int")


def _steps(texts: DataFrame, known, of, classes: int, wide: bool) -> DataFrame:
    """(h, code, next, c): a row for each occurrence of a far word (hash h) with the states around it, and the next word's
    hash if that is far too; without h, the pairs of states that no far word is in, with their counts. A code is
    (previous + 1) * (states + 1) + next + 1, where -1 is a far word. Not ``wide``: no word is far."""
    size, bound = classes + 3, classes + 1

    def run(batches):
        pairs = np.zeros(size * size, dtype=np.int64)
        state = np.append(of.value, -1 if wide else classes)
        for part in small(batches, "text"):
            words = Words(column(part, "text"))
            seq = np.concatenate(([bound], _sequence(words, state[_index(words.hash, known.value)], bound)))
            code = (seq[:-1] + 1) * size + seq[1:] + 1
            pairs += np.bincount(code[(seq[:-1] >= 0) & (seq[1:] >= 0)], minlength=len(pairs))
            if wide:
                h, around, after = _far(words, seq, size)
                yield pa.RecordBatch.from_arrays([h, around, after, pa.array(np.ones(len(h), dtype=np.int64))], ["h", "code", "next", "c"])
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.array(seen.astype(np.int32)), pa.nulls(len(seen), pa.int64()), pa.array(pairs[seen])], ["h", "code", "next", "c"])

    return cut(texts.mapInArrow(run, "h long, code int, next long, c long"), "steps")


def _far(words: Words, seq: np.ndarray, size: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Hash, code and next far word's hash (or null) of the far words of a batch in order; ``seq`` has the states with a bound
    before the first text and after each."""
    at = np.flatnonzero(seq < 0)
    hashes = np.zeros(len(seq), dtype=np.int64)
    inner = np.ones(len(seq), dtype=bool)
    inner[0] = False
    inner[words.bounds[1:] + np.arange(1, len(words.bounds))] = False  # the ends of texts
    hashes[inner] = words.hash.view(np.int64)
    code = (seq[at - 1] + 1) * size + seq[at + 1] + 1
    return pa.array(hashes[at]), pa.array(code.astype(np.int32)), pa.array(hashes[at + 1], mask=seq[at + 1] >= 0)


def _place_far(steps: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """(h, class, c, pair): every far word with its best class and its count; without h, how often (c) each pair of
    states (first * states + second) occurs that one far word is in."""
    size, states = classes + 3, classes + 2
    smooth = pairs + 0.5
    before, after = np.zeros((size, classes)), np.zeros((size, classes))
    before[1 : classes + 1] = np.log(smooth) - np.log(smooth.sum(axis=0))
    after[1 : classes + 1] = np.log(smooth).T - np.log(smooth.sum(axis=1))
    gain = (before[:, None] + after[None]).reshape(size * size, classes)

    def run(batches):
        moves = np.zeros(states * states)

        def best(h, code, times):
            """The rows of whole words, in order."""
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.add.reduceat(times, heads)
            chosen = np.add.reduceat(gain[code] * times[:, None], heads).argmax(axis=1)
            rows = np.diff(np.append(heads, len(h)))
            a, b = code // size - 1, code % size - 1
            own, once = np.repeat(chosen, rows), np.repeat(count, rows) == 1
            for use, state in ((np.ones(len(h), dtype=bool), own), (once, np.full(len(h), classes))):
                for first, second in ((a, state), (state, b)):
                    on = use & (first >= 0) & (second >= 0)
                    moves[:] += np.bincount(first[on] * states + second[on], weights=times[on], minlength=len(moves))
            return pa.RecordBatch.from_arrays([pa.array(h[heads]), pa.array(chosen.astype(np.int32)), pa.array(count.astype(np.int64)), pa.nulls(len(heads), pa.int32())], ["h", "class", "c", "pair"])

        held = None  # the last word, which may go on in the next batch: a row per code
        for part in batches:
            if not part.num_rows:
                continue
            h, code = column(part, "h").to_numpy(), column(part, "code").to_numpy().astype(np.int64)
            times = np.ones(len(h))
            if held:
                h, code, times = (np.concatenate(x) for x in zip(held, (h, code, times)))
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield best(h[:last], code[:last], times[:last])
            codes, back = np.unique(code[last:], return_inverse=True)
            held = np.full(len(codes), h[-1]), codes, np.bincount(back, weights=times[last:])
        if held:
            yield best(*held)
        seen = np.flatnonzero(moves)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.int32()), pa.array(moves[seen].astype(np.int64)), pa.array(seen.astype(np.int32))], ["h", "class", "c", "pair"])

    sorted_ = steps.where("h IS NOT NULL").select("h", "code").repartition("h").sortWithinPartitions("h")
    return cut(sorted_.mapInArrow(run, "h long, class int, c long, pair int"), "far")


def _both(pairs: DataFrame, far: DataFrame) -> DataFrame:
    """``pairs`` (h, next) of far words that stand side by side, with class and count of the first and of the second."""
    second = far.select(F.col("h").alias("next"), F.col("class").alias("class2"), F.col("c").alias("c2"))
    return pairs.join(far, "h", "left").join(second, "next", "left")


@dataclass
class Model:
    """Sorted hashes of the near words with their classes and counts, log10 transitions between states (the classes,
    that of all other words, a text's bound), and what the other words need: the counts of the classes' words and the table
    (h, class, c) of the far words, whose class is null if they have none of their own."""

    known: np.ndarray
    of: np.ndarray
    counts: np.ndarray
    classes: int
    log_move: np.ndarray
    emission: np.ndarray
    total: int
    kinds: int
    ends: int
    rare_floor: float
    weight: np.ndarray
    far: DataFrame
    wide: bool

    @property
    def floor(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.kinds + 1)))


def _sweep(training: DataFrame, known: np.ndarray, of: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """Distributed exchange: classes of all near words, from those (not -1) that there are."""
    context = training.sparkSession.sparkContext
    shared = context.broadcast(known)
    for _ in range(PASSES):
        now = context.broadcast(of)
        contexts = cut(_contexts(training, shared, now, classes), "contexts")
        best = _best_classes(contexts, _class_pairs(contexts, now, classes), classes).toPandas()
        discard(contexts)
        new = np.where(of < 0, 0, of)
        new[best.place.to_numpy(np.int64)] = best["class"].to_numpy(np.int64)
        moved = counts[new != of].sum()
        of = new
        if moved <= SETTLED * counts.sum():
            break
    return of


def fit(training: DataFrame, counts: DataFrame) -> Model:
    """The model of the rows of ``training`` (text), whose words ``counts`` (h, c) has."""
    context = training.sparkSession.sparkContext
    ends = training.count()
    words_total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = int(words_total) + ends, int(kinds) + (ends > 0)

    # by steps of the count, so that no more than NEAR rows come to the driver
    wide, most = CLASSED is None, NEAR if CLASSED is None else CLASSED
    step, held, least = F.floor(F.log2("c") * 8), 0, 0
    for x in counts.where(F.col("c") >= LEAST_COUNT).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += x["count"]
        if held > most:
            least = x.step + 1
            break
    top = counts.where((F.col("c") >= LEAST_COUNT) & (step >= least)).toPandas()
    h, c = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]

    # a seed of classes from the most frequent words among each other
    first = np.sort(h[:SEED])
    size = len(first) + 2
    pairs = _pair_counts(training, context.broadcast(first), context.broadcast(np.arange(len(first) + 1)), size).where(f"pair DIV {size} < {len(first)} AND pair % {size} < {len(first)}").toPandas()
    bigrams = np.zeros((len(first), len(first)), dtype=np.float64)
    bigrams[pairs.pair.to_numpy(np.int64) // size, pairs.pair.to_numpy(np.int64) % size] = pairs.c
    classes = max(1, min(CLASSES, len(first)))
    of_first = exchange(bigrams, classes) if len(first) else np.zeros(0, dtype=np.int64)

    order = np.argsort(h)
    h, c = h[order], c[order]
    at = _index(h, first)
    of = np.where(at < len(first), np.append(of_first, -1)[at], -1)
    if len(h):
        of = _sweep(training, h, of, c, classes)

    # transitions between classes, the class of all other words and the bound of a text
    states = classes + 2
    moves = np.zeros((states, states))
    steps = _steps(training, context.broadcast(h), context.broadcast(of), classes, wide)
    for x in steps.where("h IS NULL").groupBy("code").agg(F.sum("c").alias("c")).collect():
        moves[x.code // (states + 1) - 1, x.code % (states + 1) - 1] = x.c
    weight = np.bincount(of, weights=c, minlength=classes) if len(h) else np.zeros(classes)
    if wide:
        placed = _place_far(steps, moves[:classes, :classes].copy(), classes)
        far, rare_total, rare_kinds = placed.where("h IS NOT NULL").select("h", "class", "c"), 0, 0
        for x in placed.where("h IS NULL").groupBy("pair").agg(F.sum("c").alias("c")).collect():
            moves[x.pair // states, x.pair % states] += x.c
        beside = _both(steps.where("next IS NOT NULL").select("h", "next"), far)
        for x in beside.groupBy("class", "class2", (F.col("c") == 1).alias("once"), (F.col("c2") == 1).alias("once2")).agg(F.count("*").alias("k")).collect():
            for first in (x["class"], classes)[: 1 + x.once]:
                for second in (x["class2"], classes)[: 1 + x.once2]:
                    moves[first, second] += x.k
        for x in far.groupBy("class").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect():
            weight[x["class"]] += x.c
            rare_total, rare_kinds = rare_total + x.once, rare_kinds + x.once
    else:
        far = counts.select("h", F.lit(None).cast("int").alias("class"), "c")
        rare_total, rare_kinds = total - ends - int(c.sum()), kinds - (ends > 0) - len(h)
    discard(steps)
    unigram = (moves.sum(axis=0) + 0.5) / (moves.sum() + 0.5 * states)
    log_move = np.log10((moves + BLEND * unigram) / (moves.sum(axis=1, keepdims=True) + BLEND))
    weight = np.maximum(weight, 1)
    emission = np.log10(c / weight[of]) if len(h) else np.zeros(0)
    return Model(h, of, c, classes, log_move, emission, total, kinds, ends, float(np.log10(rare_total + 0.5 * (rare_kinds + 1))), weight, far, wide)


def _literal(values: np.ndarray) -> str:
    """SQL of an array."""
    return "array(" + ", ".join(f"{float(x)!r}D" for x in values.ravel()) + ")"


def fit_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(key).alias("held_out"))
    training = rows.where("NOT held_out").select("text")
    counts = cut(word_counts(training), "words")
    fitted = fit(training, counts)
    total, ends, floor, bound, wide, size = fitted.total, fitted.ends, fitted.floor, fitted.classes + 1, fitted.wide, fitted.classes + 3
    known, class_of = context.broadcast(fitted.known), context.broadcast(np.append(fitted.of, -1 if wide else fitted.classes))
    moves = np.zeros((size, size))  # one more at the front, for far words, whose steps are added after the join
    moves[1:, 1:] = fitted.log_move
    model = context.broadcast((np.append(fitted.emission, 0.0), moves, np.append(np.log10(fitted.counts + 0.5), 0.0), float(np.log10(ends + 0.5))))

    def run(batches):
        emit, move, own, end = model.value
        for part in small(batches, "text"):
            words = Words(column(part, "text"))
            place = _index(words.hash, known.value)
            common = place < len(known.value)
            n = np.diff(words.bounds)
            row = np.repeat(np.arange(part.num_rows), n)
            add = lambda x: np.bincount(row, weights=x, minlength=part.num_rows)  # noqa: B023, E731
            seq = np.concatenate(([bound], _sequence(words, class_of.value[place], bound)))
            steps = move[seq[:-1] + 1, seq[1:] + 1]
            cum = np.concatenate(([0.0], np.cumsum(steps)))
            edge = words.bounds + np.arange(part.num_rows + 1)  # each text has one step more than words
            n_rare = n - add(common).astype(np.int64)
            score = cum[edge[1:]] - cum[edge[:-1]] + add(emit[place])
            base = add(own[place]) + end - (n + 1) * floor
            at = pa.array(np.concatenate(([0], np.cumsum(n_rare))).astype(np.int32))
            others = _far(words, seq, size) if wide else (pa.array(words.hash[~common].view(np.int64)), pa.array(np.zeros(n_rare.sum(), dtype=np.int32)), pa.nulls(n_rare.sum(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [column(part, "_key"), column(part, "held_out"), pa.array(n + 1), pa.array(n - n_rare + (ends > 0)), pa.array(base), pa.array(score), *[pa.ListArray.from_arrays(at, x) for x in others]],
                ["_key", "held_out", "n_tokens", "n_common", "base", "own", "h", "code", "next"],
            )

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(run, f"_key {kind}, held_out boolean, n_tokens long, n_common long, base double, own double, h array<long>, code array<int>, next array<long>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")  # the row number is kept by the cut
    # words that training never saw count one half
    each = scored.select("_row", F.inline(F.arrays_zip("h", "code"))).join(fitted.far, "h", "left").withColumns({"_c": F.log10(F.coalesce("c", F.lit(0)) + 0.5), "_at": F.coalesce("class", F.lit(fitted.classes)) + 1})
    step, own = (lambda first, second: f"get({_literal(moves)}, ({first}) * {size} + {second})"), f"log10(c / get({_literal(fitted.weight)}, class))"
    value = F.expr(f"{step(f'code DIV {size}', '_at')} + {step('_at', f'code % {size}')} + if(class IS NULL, _c - {fitted.rare_floor!r}D, {own})")
    parts = each.select("_row", "_c", F.when(F.col("c").isNotNull(), 1).alias("_known"), value.alias("_v"))
    if wide:
        beside = _both(scored.select("_row", F.inline(F.arrays_zip("h", "next"))).where("next IS NOT NULL"), fitted.far)
        other = fitted.classes
        parts = parts.unionByName(beside.select("_row", F.expr(step(f"coalesce(class, {other}) + 1", f"coalesce(class2, {other}) + 1")).alias("_v")), allowMissingColumns=True)
    summed = parts.groupBy("_row").agg(F.count("_known").alias("_n"), F.sum("_c").alias("_s"), F.sum("_v").alias("_v"))
    joined = scored.drop("h", "code", "next").join(summed, "_row", "left").withColumn("score", F.col("own") + F.coalesce("_v", F.lit(0.0)))
    return joined.select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("n_common") + F.coalesce("_n", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_s", F.lit(0.0))).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
