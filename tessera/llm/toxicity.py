"""Toxicity by maximum-scoring segments of token log-odds.

Fit: in a bounded sample of labelled documents, count in how many toxic and clean ones each word and its
4, 5 and 6 byte prefixes occur. Toxic rates are shrunk along prefix4 > prefix5 > prefix6 > word: each
level's Dirichlet (beta) prior is centred on the level above, so unseen inflections inherit what their
stem has shown. A token's score is its log-odds against the base rate, less a constant that makes
ordinary text score negative.

Score: one linear pass finds every maximal scoring segment (Ruzzo and Tompa). With the extreme-value
parameters lambda and K of clean text, a segment of score S in a text of n tokens has the normalised
score lambda*S - ln(K*n); positive sums of these over a document go through a logistic curve fitted on
labelled documents that the counting didn't see.

The sample bound is SAMPLE labelled documents (the least by hash of their id), which bounds the model;
everything else covers all documents and whole texts.

Columns other than the id and the text are not looked at, whatever their names. Defined results: null and empty texts have no tokens and score as a text without segments; rows with
contradictory labels count as toxic; without labelled rows of both kinds every score is the base rate
of the rows there are (0 for none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import column, small
from tessera.llm.store import cut, discard
from tessera.llm.words import PUNCTUATION, Words

#: Labelled documents used for fitting; two thirds count, one third calibrates.
SAMPLE = 30_000
PREFIXES = (4, 5, 6)
#: Prior weight of the level above, in documents.
PRIOR = 4.0
#: What a token's log-odds must exceed to score above zero, and the score of a token without a feature.
SHIFT, UNKNOWN = 2.0, -1.0
LEAST_DOCS = 3
FEATURES = "feature long, parent long, level int, toxic int"


def _features(words: Words, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 4, 5 and 6 byte prefixes and of the whole of the words at the given places (a shorter
    word is its own prefix); the levels' hashes are made distinct."""
    order = np.argsort(at)
    start, end = words.start[at[order]], words.end[at[order]]
    levels = [words.hash_of(start, np.minimum(end, start + k)) for k in PREFIXES] + [words.hash[at[order]]]
    out = np.empty((len(levels), len(at)), dtype=np.uint64)
    for i, h in enumerate(levels):
        out[i, order] = h + np.uint64(i)
    return list(out.view(np.int64))


def _count(labelled: DataFrame) -> DataFrame:
    """(feature, parent, level, toxic docs, docs) over documents with columns text, toxic."""

    def run(batches):
        for part in small(batches, "text"):
            words = Words(column(part, "text"), PUNCTUATION)
            toxic = np.asarray(column(part, "toxic").to_numpy(zero_copy_only=False), dtype=np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(words.bounds))
            levels = _features(words, np.arange(len(words)))
            for level, h in enumerate(levels):
                parent = levels[level - 1] if level else np.zeros(len(h), dtype=np.int64)
                order = np.lexsort((row, h))
                h1, r1 = h[order], row[order]
                once = np.ones(len(h1), dtype=bool)
                once[1:] = (h1[1:] != h1[:-1]) | (r1[1:] != r1[:-1])
                h1, r1, p1 = h1[once], r1[once], parent[order][once]
                begin = np.flatnonzero(np.concatenate(([True], h1[1:] != h1[:-1]))) if len(h1) else np.zeros(0, dtype=np.int64)
                if len(begin):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1[begin]), pa.array(p1[begin]), pa.array(np.full(len(begin), level, np.int32)), pa.array(np.add.reduceat(toxic[r1], begin)), pa.array(np.diff(np.concatenate((begin, [len(h1)]))))],
                        ["feature", "parent", "level", "toxic", "docs"],
                    )

    rows = labelled.mapInArrow(run, "feature long, parent long, level int, toxic long, docs long")
    return rows.groupBy("feature", "level").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))


@dataclass
class Model:
    """Sorted feature hashes with their scores, extreme-value parameters and the logistic curve."""

    base: float
    features: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] | None = None

    def token_scores(self, words: Words) -> np.ndarray:
        """The score of each word: that of its most specific feature in the model."""
        unique, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        out = np.full(len(unique), UNKNOWN)
        if len(self.features):
            for h in _features(words, first):
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                hit = self.features[at] == h
                out[hit] = self.scores[at[hit]]
        return out[back]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Ruzzo and Tompa's scan with the candidates on a stack; only positive scores open a candidate, so runs
    of negative ones cost one prefix sum.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0):
        start, end, left, right = int(i), int(i) + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        # candidates that begin at a higher sum can't be joined any more, they stay as they are
        stack.append((start, end, left, right))
    return [(s, e, float(r - x)) for s, e, x, r in stack]


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1."""
    p = weights / weights.sum()
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small ridge."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _evidence(model: Model, found: list[tuple[int, int, float]], n: int) -> float:
    """Sum over significant segments of their normalised scores."""
    floor = np.log(max(model.k * max(n, 1), 1e-9))
    return float(sum(max(0.0, model.lam * s - floor) for _, _, s in found))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """``labels`` has ``key`` and toxic; documents without a label don't count."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(sample)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    # the sample's texts are read once more than they are written here, instead of once by each step
    rows = cut(rows.select("text", "toxic", "_h"), "sample")
    fold = F.pmod("_h", F.lit(3)) == 0
    counting = rows.where(~fold).select("text", "toxic")
    n_docs, n_toxic = counting.agg(F.count("*"), F.sum("toxic")).first()
    base = (n_toxic or 0) / n_docs if n_docs else 0.0
    if not 0 < base < 1:
        return Model(base, np.zeros(0, dtype=np.int64), np.zeros(0))
    counts = cut(_count(counting).where(F.col("docs") >= LEAST_DOCS), "counts")
    # shrink level by level; each level is joined to the posterior rate of the one above
    above, levels = None, []
    logit = lambda r: F.log(r / (1 - r))
    for level in range(len(PREFIXES) + 1):
        own = counts.where(F.col("level") == level)
        prior = F.lit(base)
        if above is not None:
            own = own.join(above.select(F.col("feature").alias("parent"), F.col("rate").alias("_prior")), "parent", "left")
            prior = F.coalesce("_prior", F.lit(base))
        own = own.withColumn("rate", (F.col("toxic") + PRIOR * prior) / (F.col("docs") + PRIOR)).withColumn("up", logit(prior) - logit(F.lit(base)))
        above = own.withColumn("odds", logit(F.col("rate")) - logit(F.lit(base))).select("feature", "docs", "rate", "odds", "up")
        levels.append(above)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    kept = every.where((F.col("odds") > SHIFT) | (F.col("up") > SHIFT)).select("feature", "odds").toPandas().sort_values("feature")
    discard(counts)
    model = Model(base, kept.feature.to_numpy(np.int64), np.clip(kept.odds.to_numpy(float), -2, 8) - SHIFT)
    model = _calibrate(model, rows.where(fold).select("text", "toxic"))
    discard(rows)
    return model


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """Extreme-value parameters from clean documents and the logistic curve. Sums are made by Spark; the driver gets
    a histogram, two means and at most SAMPLE pairs of numbers for the curve."""
    edges = np.arange(-4, 8.01, 0.25)

    def run(batches):
        for part in small(batches, "text"):
            words = Words(column(part, "text"), PUNCTUATION)
            scores = model.token_scores(words)
            out = []
            for i in range(part.num_rows):
                s = scores[words.bounds[i] : words.bounds[i + 1]]
                out.append((len(s), [x for _, _, x in segments(s)], np.histogram(s, edges)[0].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64())), pa.array([x[2] for x in out], pa.list_(pa.int64())), column(part, "toxic")], ["n", "found", "histogram", "toxic"])

    got = cut(rows.mapInArrow(run, "n long, found array<double>, histogram array<long>, toxic int"), "calibration")
    clean = got.where("toxic = 0")
    if not clean.limit(1).count() or not got.where("toxic <> 0").limit(1).count():
        return model
    bins = dict(clean.select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col")).collect())
    weights = np.array([bins.get(i, 0) for i in range(len(edges) - 1)], dtype=float) + 1e-3
    model.lam = _lambda((edges[:-1] + edges[1:]) / 2, weights)
    # maxima m of texts of n tokens follow a Gumbel law: the mean of lambda * m - ln(n) is ln K plus Euler's constant
    best, n = F.coalesce(F.array_max("found"), F.lit(0.0)), F.greatest("n", F.lit(1))
    model.k = float(np.exp(clean.agg(F.avg(model.lam * best - F.log(n))).first()[0] - 0.5772))
    floor = F.log(F.greatest(model.k * n, F.lit(1e-9)))
    evidence = F.aggregate("found", F.lit(0.0), lambda t, x: t + F.greatest(F.lit(0.0), model.lam * x - floor))
    points = got.select(F.log1p(evidence).alias("x"), F.col("toxic").cast("double").alias("y")).toPandas()
    model.curve = _logistic(points.x.to_numpy(), points.y.to_numpy())
    discard(got)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted and the toxic passages as (first word, end word, score). Map-only."""

    def run(batches):
        for part in small(batches, "text"):
            words = Words(column(part, "text"), PUNCTUATION)
            scores = model.token_scores(words)
            probability, passages = [], []
            hot = np.add.reduceat(np.concatenate((scores > 0, [False])), words.bounds[:-1]) * (np.diff(words.bounds) > 0) if len(scores) else np.zeros(part.num_rows)
            for i in range(part.num_rows):
                n = int(words.bounds[i + 1] - words.bounds[i])
                found = segments(scores[words.bounds[i] : words.bounds[i + 1]]) if hot[i] else []
                if model.curve is None:
                    probability.append(model.base)
                else:
                    a, b = model.curve
                    probability.append(1 / (1 + np.exp(-(a * np.log1p(_evidence(model, found, n)) + b))))
                floor = np.log(max(model.k * max(n, 1), 1e-9))
                passages.append([{"first": s, "end": e, "score": x} for s, e, x in found if model.lam * x > floor])
            yield pa.RecordBatch.from_arrays(
                [column(part, "_key"), pa.array(probability, pa.float64()), pa.array([int(p >= 0.5) for p in probability], pa.int32()), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                ["_key", "score", "predicted", "passages"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"_key {kind}, score double, predicted int, passages array<struct<first:long,end:long,score:double>>").withColumnRenamed("_key", key)


def reject_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic. Map-only."""
    schema, place = docs.schema, docs.columns.index(text)

    def run(batches):
        for part in small(batches, text):
            words = Words(part.column(place), PUNCTUATION)
            scores = model.token_scores(words)
            keep = []
            for i in range(part.num_rows):
                s = scores[words.bounds[i] : words.bounds[i + 1]]
                p = model.base
                if model.curve is not None:
                    found = segments(s) if (s > 0).any() else []
                    p = 1 / (1 + np.exp(-(model.curve[0] * np.log1p(_evidence(model, found, len(s))) + model.curve[1])))
                keep.append(bool(p < 0.5))
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether a row is outside the training folds: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
