"""Fill-in-the-middle against the definition, and its boundary lists on random numbers."""

import hashlib
import random
import re

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
TEXTS = [
    "one\ntwo\nthree", "one\ntwo\nthree", "one\ntwo\nthree\n", None, "", "\n", "\n\n\n", "a <S> marker\nb", "<P", "é日本😀\n１２３\n<\n<S\nM>\r\n\x85 x", "x" * 100_000 + "\n" + "y\n" * 5000, "no line feed",
]


def defined(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(10 * i + k, t) for i, t in enumerate(TEXTS) for k in range(4)] + [(None, "a\nb\nc"), (7, "same\nrow"), (7, "same\nrow"), (7, "other\nrow")]
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], "doc_id long, text string, form string, n int, _hash string").repartition(3)


def test_transform_against_the_definition(spark, edges):
    from tessera.llm.fim import restore, transform

    for docs in (edges, spark.read.parquet(f"{SF}/documents.parquet")):
        for rate, spm in ((100, 50), (60, 0)):
            given = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in docs.collect()), key=str)
            expected = sorted((str((d, *defined(d, t, rate, spm)[:4])), hashlib.sha256(defined(d, t, rate, spm)[4].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for _, d, t in given)
            got = transform(docs, rate=rate, spm=spm).collect()
            assert sorted((str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars)), r.output_sha256, r.restored_sha256) for r in got) == expected
            assert all(hashlib.sha256(restore(r.form, r.output).encode()).hexdigest() == r.restored_sha256 for r in got)
    assert {r.form for r in got} == {"plain", "psm"}
    assert transform(edges.limit(0)).count() == 0


def test_index_holds_the_ends_of_lines(edges):
    from tessera.llm.fim import EliasFano, index_texts

    texts = {(r.doc_id, len(r.text or "")): r.text or "" for r in edges.collect()}
    for r in index_texts(edges).collect():
        ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", texts[r.doc_id, r.n_chars])]
        held = EliasFano.loads(bytes(r.boundaries), r.n, r.n_chars)
        assert [held.select(i) for i in range(min(r.n, 50))] == ends[:50] and r.n == len(ends)
        assert len(r.boundaries) <= r.n * (2 + max(1, r.n_chars // max(r.n, 1)).bit_length()) // 8 + 4


def test_lists_against_random_numbers():
    from tessera.llm.fim import EliasFano

    rng = random.Random(3)
    for _ in range(300):
        n, limit = rng.randint(0, 80), rng.choice((1, 7, 100, 5000, 1 << 20))
        values = sorted(rng.randint(0, limit) for _ in range(n))
        again = EliasFano.loads(EliasFano(np.array(values, dtype=np.int64), limit).dumps(), n, limit)
        assert [again.select(i) for i in range(n)] == values


def test_equal_hashes_of_different_texts_are_told_apart():
    import pyarrow as pa

    from tessera.llm.fim import _entries

    batch = pa.record_batch({"text": ["a\nb", "a", "a\nb"], "_hash": [5, 5, 5]})
    (_, _, found), = _entries(iter([batch]), "text")
    assert [n for n, _ in found] == [2, 1, 2] and found[0] is found[2]


def test_copies_span_partitions(spark):
    from pyspark.sql import functions as F

    from tessera.llm.fim import _by_text
    from tessera.llm.store import setting

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        sizes = [r["count"] for r in _by_text(docs, "text", "doc_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
