"""Reading mixed JSON, tables brought up to date in place, page texts and natural order."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import archive
from tessera.sources import json_tables, store


@pytest.mark.parametrize("body, expected", [
    ('[{"k": 1}, 5, {"k": 2}, "s", null, [{"k": 9}], {}]', [1, 2, None]), ('{"rows": [{"k": 1}, 5, {"k": 2}]}', [1, 2]), ('{"rows": {"k": 1}}', []), ('{"other": [{"k": 1}]}', []), ("[]", []), ("", []),
    ("not json", []), ('["{\\"k\\": 7}"]', []), ('[{"k": "x"}, {"k": 3, "more": {"a": [1]}}]', [None, 3]), ('  [\n{"k": 1}]', [1]), ("5", []), ("null", []),
])
def test_mixed_lists_keep_their_objects(spark, tmp_path, body, expected):
    (tmp_path / "a.json").write_text(body)
    rows = json_tables.read_json(spark, f"file://{tmp_path}/a.json", "k int", "rows").collect()
    assert sorted((r.k is not None, r.k or 0) for r in rows) == sorted((k is not None, k or 0) for k in expected)
    bare = json_tables.read_json(spark, f"file://{tmp_path}/a.json", "k int").collect()
    assert len(bare) == (len(expected) if body.lstrip().startswith("[") else 0)


def test_a_failed_snapshot_leaves_the_live_table(spark, tmp_path):
    root, one = f"file://{tmp_path}/t", spark.createDataFrame([(1,)], "k int")
    assert json_tables.read_live(spark, root, "k int").count() == 0
    json_tables.write_snapshot(one, root, "2026-01-01", "061700")
    with pytest.raises(Exception, match="lost"):
        json_tables.write_snapshot(one.select(F.raise_error(F.lit("lost")).cast("int").alias("k")), root, "2026-01-02", "061700")
    assert json_tables.read_live(spark, root, "k int").first().k == 1
    json_tables.write_snapshot(one.union(one), root, "2026-01-02", "061700")  # the run again
    assert json_tables.read_live(spark, root, "k int").count() == 2 and json_tables.previous_snapshot(spark, root, "2026-01-02", "061700").count() == 1
    assert json_tables.previous_snapshot(spark, root, "2026-01-03", "000000").count() == 2


def test_the_snapshot_before_is_found_by_date_and_time(spark, tmp_path):
    root, one = f"file://{tmp_path}/s", spark.createDataFrame([(1,)], "k int")
    runs = [("2026-07-19", "181700"), ("2026-07-20", "061700"), ("2026-07-20", "181700")]
    for i, run in enumerate(runs):
        json_tables.write_snapshot(one.select(F.lit(i).alias("k")), root, *run)
    for i, run in enumerate(runs):
        assert [r.k for r in json_tables.previous_snapshot(spark, root, *run).collect()] == ([i - 1] if i else [])


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_unchanged_partitions_keep_their_files(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    made = lambda changed: spark.createDataFrame([(f"data/{i}.json", f"h{i}" + "x" * (i in changed), i) for i in range(200)], "key string, sha string, size long")
    assert store.push(made(()), root, "key", "sha", 16) == {"upload-new": 200, "upload-changed": 0, "skip": 0}
    before = listing(tmp_path / "store")
    assert store.push(made(()), root, "key", "sha", 16) == {"upload-new": 0, "upload-changed": 0, "skip": 200} and listing(tmp_path / "store") == before
    more = made((3, 4)).where("size <> 7").unionByName(spark.createDataFrame([("data/new.json", "h", 1)], "key string, sha string, size long"))
    assert store.push(more, root, "key", "sha", 16) == {"upload-new": 1, "upload-changed": 2, "skip": 197}
    after = listing(tmp_path / "store")
    kept = {p for p in before if after.get(p) == before[p]}
    assert 13 <= len({p.split("bucket=")[1].split("/")[0] for p in kept}) < 16
    rows = {r.key: r.sha for r in store.read(spark, root, more.schema).collect()}
    assert len(rows) == 201 and rows["data/3.json"] == "h3x" and rows["data/7.json"] == "h7" and rows["data/new.json"] == "h"


def test_sets_are_replaced(spark, tmp_path):
    root, shape = f"file://{tmp_path}/watch", "uid string, number string, title string"
    made = lambda rows: spark.createDataFrame(rows, shape)
    owners = lambda *names: spark.createDataFrame([(n,) for n in names], "uid string")
    start = [(f"u{i}", str(n), "t") for i in range(40) for n in range(3)]
    assert store.replace_sets(made(start), owners(*{r[0] for r in start}), root, "uid", "number", 8) == {"insert": 120, "update": 0, "delete": 0, "keep": 0}
    before = listing(tmp_path / "watch")
    assert store.replace_sets(made([("u1", "0", "t"), ("u1", "9", "t"), ("u1", "1", None), ("u5", "x", "not an owner")]), owners("u1", "u2"), root, "uid", "number", 8) == {"insert": 1, "update": 1, "delete": 4, "keep": 1}
    after = listing(tmp_path / "watch")
    assert any(after.get(p) == before[p] for p in before) and any(p not in after for p in before)
    rows = {(r.uid, r.number, r.title) for r in store.read(spark, root, made([]).schema).collect()}
    assert rows == {r for r in start if r[0] not in ("u1", "u2")} | {("u1", "0", "t"), ("u1", "9", "t"), ("u1", "1", None)}
    assert store.replace_sets(made([]), owners(*{r[0] for r in start}), root, "uid", "number", 8)["delete"] == 117
    assert store.read(spark, root, made([]).schema).count() == 0


def page_loop(pages, least, max_pages, max_ocr, max_characters):
    alnum = lambda s: len(re.sub("[^A-Za-z0-9]", "", s or ""))
    texts = [t or "" for t, _ in pages[:max_pages]]
    sparse = [i for i, t in enumerate(texts) if alnum(t) < least]
    used = []
    for i in sparse[:max_ocr]:
        if alnum(pages[i][1]) > alnum(texts[i]):
            texts[i] = pages[i][1]
            used.append(i + 1)
    whole = "\n\n".join(f"--- Page {i + 1} ---\n{t.strip()}" for i, t in enumerate(texts) if t.strip())
    method = "ocr" if used and len(used) == len(texts) else "hybrid" if used else "embedded" if whole[:max_characters] else "none"
    return whole[:max_characters], len(texts), method, used, [i + 1 for i in sparse], (len(pages) > max_pages) + (len(sparse) > max_ocr) + (len(whole) > max_characters)


@pytest.mark.parametrize("limits", [(80, 300, 12, 2_000_000), (5, 4, 1, 70), (5, 3, 2, 17), (200, 300, 100, 500)])
def test_page_texts_equal_the_loop(spark, limits):
    rng = random.Random(limits[3])
    word = lambda: rng.choice(["", " ", "ab", "x" * 90, "é日本", "\n\t", "two\nlines ", "\x85", None])
    documents = {f"d{k}": [(word() and word(), word()) for _ in range(rng.randint(1, 9))] for k in range(40)}
    rows = [(d, i, t, o) for d, pages in documents.items() for i, (t, o) in enumerate(pages, 1)]
    rng.shuffle(rows)
    got = archive.page_texts(spark.createDataFrame(rows, "doc string, page int, text string, ocr_text string"), "doc", *limits).collect()
    assert {r.doc: (r.text, r.page_count, r.method, r.ocr_pages, r.sparse_pages, len(r.warnings)) for r in got} == {d: page_loop(p, *limits) for d, p in documents.items()}
    assert all(r.character_count == len(r.text) for r in got)


def test_natural_order(spark):
    wanted = ["", " b", "-1", "2", "10", "010a", "a", "a-", "a9", "a10", "A10b", "Éa2", "e b", "É10", "eclair", "éclair 2", "Eclair 10", "z", "ζ"]
    wanted = ["", " b", "-1", "2", "10", "010a", "a", "a-", "a9", "a10", "A10b", "é2", "E10", "éclair 2", "Eclair 10", "z", "ζ"]
    mixed = wanted[:]
    random.Random(1).shuffle(mixed)
    df = spark.createDataFrame([(x,) for x in mixed], "s string")
    assert [r.s for r in df.orderBy(text.natural_key(F.col("s"))).collect()] == wanted
    same = lambda a, b: spark.range(1).select((text.natural_key(F.lit(a)) == text.natural_key(F.lit(b))).alias("x")).first().x
    assert same("É", "e") and same("a 007", "A 7") and not same("a9", "a10")


def test_page_texts_cut_within_a_separator(spark):
    pages = [("d", 1, "x" * 10, None), ("d", 2, "y", None)]
    df = spark.createDataFrame(pages, "doc string, page int, text string, ocr_text string")
    for limit in range(24, 32):  # the first page and its marker end at 25, the separator at 27
        got = archive.page_texts(df, "doc", 0, 300, 12, limit).first()
        assert (got.text, len(got.warnings)) == ("--- Page 1 ---\nxxxxxxxxxx\n\n--- Page 2 ---\ny"[:limit], 1)
