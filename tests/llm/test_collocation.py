"""Phrase mining against a count of every phrase, and its lists and filters against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def defined(rows, longest=3, least=10, top=2000, overlap=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        rows = []
        for p, a in candidates.items():
            if p in most and 100 * most[p] >= overlap * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, left, right, n, score))
        out += [(lang, i, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["a", "b", "B", "ç", "dé", "日", "x" * 300, "e'f", "-", "\x0b", "\x85", "\xa0"]
    made = [(rng.choice(("en", "de", None, "und", "", "e\tn")), "".join(rng.choice(words) + rng.choice((" ", "  ", "\t", " ", ". ", ",", "\n", " ")) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return made + [("en", None), (None, None), ("en", ""), ("en", " \t\n.,"), ("en", "lone"), ("en", "z " * 30_000), *[("fr", "aa bb cc")] * 12]


def test_collocations_against_brute_force(spark, texts):
    from tessera.llm.collocation import collocations

    docs = spark.createDataFrame([(i, t, x, "y", 2, "s") for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string, f int, spelled string").repartition(4)
    for longest, least, top, overlap in ((3, 10, 2000, 50), (4, 2, 7, 90), (2, 3, 1, 50)):
        assert rows_of(collocations(docs, longest, least, top, overlap)) == defined(texts, longest, least, top, overlap)
    assert collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", (10, 200_000))  # more words than are broadcast, and fewer
def test_candidates_are_made_once(spark, texts, monkeypatch, few):
    from pyspark.sql import functions as F

    from tessera.llm import collocation

    docs = spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string").repartition(4)
    made, expected = {}, {}

    def counted(name):
        real, rows = getattr(collocation, name), spark.sparkContext.accumulator(0)

        def seen(_):
            rows.add(1)
            return True

        def run(*given):
            out = real(*given)
            made[name], expected[name] = rows, out.count()
            return out.where(F.udf(seen, "boolean").asNondeterministic()("phrase"))

        monkeypatch.setattr(collocation, name, run)

    monkeypatch.setattr(collocation, "FEW", few)
    counted("_covered")
    counted("_beyond")
    assert rows_of(collocation.collocations(docs, top=20)) == defined(texts, top=20)
    assert {k: v.value for k, v in made.items()} == expected and min(expected.values()) > 0


def test_query_against_brute_force(spark):
    from tessera.llm.entries import QUERIES

    given = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_phrase_collocations"](spark, SF)
    assert rows_of(got) == defined(given) and dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")


def test_words_that_share_a_number_are_told_apart(spark, texts):
    from tessera.llm.collocation import build_index

    docs = spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string").repartition(3)
    expected = Counter(f"{'und' if x is None else x}\t{w}" for x, t in texts for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    for bits in (4, 64):  # sixteen numbers for all words: nearly all get others
        index, words = build_index(docs, bits=bits)
        rows = words.collect()
        assert {r.spelled: r.f for r in rows} == expected and len({bytes(r.phrase) for r in rows}) == len(rows) == len(expected)
        assert sum(sum(r.sizes) for r in index.collect()) == sum(expected.values())


def test_tasks_hold_bounded_pieces(spark, texts, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import collocation

    monkeypatch.setattr(collocation, "BLOCK", 3000)
    docs = spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string").coalesce(1)
    index, _ = collocation.build_index(docs)
    files = index.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and max(r["count"] for r in files) <= collocation.BLOCKS

    phrases, counts = np.arange(200_000, dtype=np.uint64).reshape(-1, 2), np.arange(1, 100_001)
    passed = list(collocation._passed(phrases, counts))
    assert max(b.num_rows for b in passed) <= 1 << 14 and np.concatenate([b.column(1).to_numpy() for b in passed]).tolist() == counts.tolist()
    assert (np.concatenate([collocation._numbers(b.column(0), 2) for b in passed]) == phrases).all()
    assert not list(collocation._passed(phrases[:0], counts[:0]))


def test_lists_are_the_occurrences(texts):
    import pyarrow as pa

    from tessera.llm.collocation import _block, extend

    class All:
        holds = staticmethod(lambda phrases: np.ones(len(phrases), dtype=bool))

    part = pa.record_batch({"text": [t for _, t in texts], "lang": ["x"] * len(texts)})
    numbers, sizes, spelled, positions = _block(part, "text", "lang", {})
    ids = np.array(numbers, dtype=np.int64).view(np.uint64)
    word = {int(i): s.split("\t")[1] for i, s in zip(ids, spelled)}
    counted = Counter()
    for _, text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            counted.update(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    phrases, counts = extend(ids, np.array(sizes), np.frombuffer(positions, dtype="<i4").astype(np.int64), [All, All])
    assert {tuple(word[int(x)] for x in p): int(n) for p, n in zip(phrases, counts)} == counted


def test_filter_holds_all_of_its_set(spark):
    from tessera.llm.collocation import Filter

    members = np.arange(2000, dtype=np.uint64).reshape(-1, 2) * np.uint64(0x9E3779B97F4A7C15)
    table = spark.createDataFrame([(bytearray(r.astype(">u8").tobytes()),) for r in members], "phrase binary")
    kept = Filter(table, 2)
    others = members + np.uint64(1)
    assert kept.holds(members).all() and kept.holds(others).mean() < 0.05


def test_scores_are_exact_beyond_64_bits(spark):
    from tessera.llm.collocation import SCORE

    values = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10, 10, 10), (3_000_000_019, 3_000_000_037, 9_000_000_001), (11, 10**12, 11)]
    got = [r[0] for r in spark.createDataFrame(values, "a long, l long, r long").selectExpr(SCORE).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in values]
