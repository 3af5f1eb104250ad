"""Behaviour that a naive rewrite would get wrong."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, text, urls
from tessera.operators import alerts, diff, graph
from tessera.operators.dedup import keep_newest, keep_ranked


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [
    ("Monday, July 20, 2026", "2026-07-20"), ("July 15, 2026", "2026-07-15"), ("2026-Jul-15", "2026-07-15"), ("2026-07-15", "2026-07-15"), ("February 31, 2026", None), ("", None),
    # the form with a weekday goes first on the whole text
    ("Posted July 15, 2026 for Monday, July 20, 2026", "2026-07-20"), ("Monday, Junk 40, 2026 and July 1, 2026", None), ("2026-07-15 or July 4, 2026", "2026-07-04"),
])
def test_parse_date(spark, value, expected):
    assert one(spark, dates.parse_date(F.lit(value))) == expected


@pytest.mark.parametrize("value, expected", [("industrial site", "Environment"), ("parking fees", "Transportation"), ("refund", "Finance"), ("xyz", "Other"), (None, "Other")])
def test_category(spark, value, expected):
    assert one(spark, text.keyword_category(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [("passed first reading", "Passed"), ("gave first reading", "First Reading"), ("noted", "Discussed")])
def test_action(spark, value, expected):
    assert one(spark, text.item_action(F.lit(value))) == expected


@pytest.mark.parametrize("value, expected", [("HTTPS://Ex.com//a/?b=2&_=9&a=1#x", "https://ex.com/a?a=1&b=2"), ("http://A.b", "http://a.b/"), (None, "")])
def test_canonical_url(spark, value, expected):
    assert one(spark, urls.canonical_url(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("number, body, kind, expected", [
    ("9000", "amends Bylaw 4000 and Bylaw 5000", "amends", ["5000"]),
    ("9000", "amends Bylaw No. 4000 and Bylaw No. 5000", "amends", ["4000"]),
    ("4500.123", "", "amends", ["4500"]),
    ("4000", "Bylaw 4000 was repealed by Bylaw 5000", "repealed_by", ["5000"]),
    ("4000", "Bylaw 4000 was repealed by Bylaw 5000", "repeals", ["5000"]),
    ("5000", "Bylaw 4000 was repealed by Bylaw 5000", "repeals", ["4000"]),
])
def test_relationships(spark, number, body, kind, expected):
    assert one(spark, graph.infer_relationships(F.lit(number), F.lit(body)))[kind] == expected


@pytest.mark.parametrize("a, b, expected", [("", "x", "x"), ("0", "5", "0"), ("false", "5", "false"), ("[]", "5", "[]"), ("0.0", "5", "0.0"), (None, "y", "y")])
def test_first_truthy(spark, a, b, expected):
    assert one(spark, text.first_truthy(F.lit(a).cast("string"), F.lit(b))) == expected


def test_ranked_dedup_last_wins(spark):
    rows = spark.createDataFrame([("k", "agenda", 0, 1), ("k", "minutes", 2, 2), ("k", "summary a", 3, 3), ("k", "summary b", 3, 4)], "id string, kind string, rank int, pos int")
    assert keep_ranked(rows, ["id"], F.col("rank"), "pos").first()["kind"] == "summary b"


def test_event_status(spark):
    status = lambda *a: one(spark, diff.event_status(*a))
    assert status(F.lit("added"), F.lit("x")) == "New"
    assert status(F.lit("removed"), F.lit("x")) == "Repealed"
    assert status(F.lit("changed"), F.lit("title only")) == "Amended"
    assert status(F.lit("changed"), F.lit("title only"), F.lit(True)) == "Repealed"


def test_remember_keeps_first_occurrences_then_last(spark):
    keys = F.array(*map(F.lit, ["a", "b", "a", "", "c", "d"]))
    assert one(spark, alerts.remember(keys, 3)) == ["b", "c", "d"]


def test_html(spark):
    assert one(spark, text.html_escape(F.lit('<script>alert("x")</script>'))) == "&lt;script&gt;alert(&quot;x&quot;)&lt;/script&gt;"
    assert one(spark, text.html_to_text(F.lit("<p>a</p><script>x</script> b"))) == "a b"


def test_sources(spark, tmp_path):
    from tessera.sources import json_tables as j

    (tmp_path / "a.json").write_text('{"rows": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "b.json").write_text('[{"k": 3}]')
    (tmp_path / "c.json").write_text("not json")
    read = lambda n: sorted(r.k for r in j.read_json(spark, f"file://{tmp_path}/{n}", "k int", "rows").collect())
    assert read("a.json") == [1, 2] and read("b.json") == [3] and read("c.json") == [] and read("missing.json") == []
    df = spark.createDataFrame([(1,)], "k int")
    root = f"file://{tmp_path}/t"
    j.write_snapshot(df, root, "2026-01-01", "061700")
    j.write_snapshot(df.union(df), root, "2026-01-02", "061700")
    assert j.previous_snapshot(spark, root, "2026-01-02", "061700").count() == 1
    assert j.previous_snapshot(spark, root, "2026-01-01", "061700").count() == 0
    with pytest.raises(Exception, match="empty"):
        j.require(df.where("k > 5"), F.count("*") == 0, "empty").collect()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Vancouver"])
@pytest.mark.parametrize("value, expected", [
    ("2026-07-20T10:00:00Z", "2026-07-20 10:00:00"), ("2026-07-20T10:00:00-07:00", "2026-07-20 17:00:00"), ("2026-07-20T10:00:00", "2026-07-20 17:00:00"),
    ("2026-01-20", "2026-01-20 08:00:00"), ("2026-07-20Tx", "2026-07-20 19:00:00"), ("nothing", None), ("", None),
])
def test_times_do_not_depend_on_the_session(spark, zone, value, expected):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = spark.range(1).select(F.unix_seconds(dates.normalize_datetime(F.lit(value))).alias("x")).first().x
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert at == (None if expected is None else one(spark, F.unix_seconds(F.to_timestamp(F.lit(expected)))))


def test_newest_dedup_first_wins_on_ties(spark):
    rows = spark.createDataFrame([("k", 5, 1), ("k", 9, 2), ("k", 9, 3), ("k", 1, 4)], "id string, time int, pos int")
    assert keep_newest(rows, ["id"], "time", "pos").first()["pos"] == 2


def test_empty_values_are_carried_forward(spark):
    from tessera.operators import archive

    new = spark.createDataFrame([(1, "", "n"), (2, None, "n"), (3, "own", "n")], "k int, pdf_sha string, title string")
    old = spark.createDataFrame([(1, "a", "o"), (2, "b", "o"), (3, "c", "o")], "k int, pdf_sha string, title string")
    assert {tuple(r) for r in archive.carry_forward(new, old, "k", ("pdf_",)).collect()} == {(1, "a", "n"), (2, "b", "n"), (3, "own", "n")}


def test_a_missing_hash_is_no_change(spark):
    a = spark.createDataFrame([(1, "x", "t"), (2, None, "t"), (3, "x", "t"), (4, "x", "t")], "k int, sha string, title string")
    b = spark.createDataFrame([(1, "y", "t"), (2, "y", "t"), (3, None, "t"), (4, "x", None)], "k int, sha string, title string")
    assert {(r.k, tuple(r.changed_fields)) for r in diff.snapshot_diff(a, b, "k", ["sha", "title"], if_known=("sha",)).collect()} == {(1, ("sha",)), (4, ("title",))}


def test_links(spark):
    assert one(spark, urls.valid_url(F.lit("HTTPS://a.b/c"))) and not one(spark, urls.valid_url(F.lit("ftp://a.b/c")))
    link = lambda label, href: one(spark, urls.is_document_link(F.lit(label), F.lit(href)))
    assert link("Agenda", "/x.pdf") and link("", "/files/a.ashx") and not link("Watch video", "/x.pdf") and not link("Agenda", "/calendar.aspx")
    assert one(spark, urls.is_meeting_link(F.lit("Special COUNCIL"), F.lit(None).cast("string"), F.lit("/View?ID=3"))) and not one(spark, urls.is_meeting_link(F.lit("Contact"), F.lit("us"), F.lit("/View?ID=3")))
    assert [one(spark, urls.byte_label(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(spark, urls.committee_pdf(F.lit("../a\\b.pdf?x"))) == "a/b.pdf" and one(spark, urls.committee_pdf(F.lit("a/../b.pdf"))) == ""
    assert one(spark, urls.encoded_canonical_url(F.lit("HTTP://A.b//c//d/?z=%7Ex&_=1&Y=a%20b#f"))) == "http://a.b/c/d?Y=a+b&z=~x"


@pytest.mark.parametrize("value, context, expected", [("Finance Committee Agenda", "", "Finance Committee"), ("Agenda", "Parks Commission - July 2, 2026", "Parks Commission"), ("Home", "page", "Home")])
def test_meeting_title(spark, value, context, expected):
    assert one(spark, text.meeting_title(F.lit(value), F.lit(context))) == expected


@pytest.mark.parametrize("value, expected", [("7331", 7331.0), ("4500.123", 4500.00123), ("none", float("-inf")), ("1.2.3", None), (None, float("-inf"))])
def test_numeric_key(spark, value, expected):
    assert one(spark, text.numeric_key(F.lit(value).cast("string"))) == expected


def test_fingerprints(spark):
    from tessera.functions import hashes

    a, b = (one(spark, hashes.fingerprint(F.lit(x).cast("string").alias("p"), F.lit(y).cast("string").alias("q"))) for x, y in ((None, "x"), ("x", None)))
    assert a != b
    assert one(spark, hashes.identity(F.lit(" id "), F.lit(1))) == "id" and len(one(spark, hashes.identity(F.lit(" "), F.lit(1)))) == 16


def test_relationship_edges(spark):
    found = spark.range(1).select(F.lit("9000").alias("number"), graph.infer_relationships(F.lit("9000"), F.lit("amends Bylaw No. 4000 and repeals Bylaw No. 5000")).alias("r"))
    assert {(r.source, r.target, r.type) for r in graph.edges(found, "number", "r").collect()} >= {("9000", "4000", "amends"), ("9000", "5000", "repeals")}
    assert found.select(graph.targets("r").alias("t")).first().t == ["4000", "5000"]


def test_remembered_state_is_merged(spark):
    from tessera.streaming.incremental import merge_state

    state = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", ["9"])], "who string, keys array<string>")
    batch = spark.createDataFrame([("a", "3"), ("a", "4"), ("c", "5")], "who string, key string")
    assert {r.who: r["keys"] for r in merge_state(state, batch, "who", "key", 3).collect()} == {"a": ["2", "3", "4"], "b": ["9"], "c": ["5"]}


def test_file_index(spark, tmp_path):
    import hashlib

    from tessera.sources.json_tables import file_index

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [(r.length, r.sha256) for r in file_index(spark, f"file://{tmp_path}").collect()] == [(5, hashlib.sha256(b"%PDF-").hexdigest())]


def test_alerts_without_category_reach_everyone_with_the_type(spark):
    events = spark.createDataFrame([("e1", "new", "x", 5), ("e2", "new", "", 5), ("e3", "new", None, 5), ("e4", "old", "x", 5), ("e5", "new", "x", 0), ("e6", "new", "*", 5)], "key string, change_type string, category string, occurred_at int")
    groups = spark.createDataFrame([("a", 1, ["new"], ["x"], False), ("b", 1, ["new"], ["y"], False), ("c", 1, ["new", "old"], [], True)], "recipient string, activation_at int, change_types array<string>, categories array<string>, all_categories boolean")
    got = {(r.recipient, r.key) for r in alerts.match(events, groups).collect()}
    assert got == {("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", "e2"), ("b", "e3"), *(("c", k) for k in ("e1", "e2", "e3", "e4", "e6"))}


def test_lengths_of_sentences_cut_at_a_blank(spark, tmp_path):
    from tessera.plans import catalogue

    spark.createDataFrame([(1, "a" * 2399 + " " + "b" * 50), (2, "a" * 2400 + " " + "b" * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["sentence_chunks"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 2400), (2, 2, 2400)]
    chunk = spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("doc_id").select(text.sentence_chunks(F.col("text")).alias("c"))
    assert [[len(x) for x in r.c] for r in chunk.collect()] == [[2399, 50], [2400, 50]]


def test_bodies_of_references_are_searched_only_where_there_is_one(spark):
    """A long text that only looks like references takes little time, where trying every letter takes many times as long."""
    import time

    long = "Amended Fees and Rates Bylaw was repealed by the City of Examples and replaced by others, consolidated by all " * 10_000
    short = "Zoning Bylaw 2011 No. 4000 is hereby repealed. Fees Bylaw 9000 was amended by Parks Bylaw No. 500, and Bylaw 77 by Bylaw 78"
    df = spark.createDataFrame([(1, short), (2, long)], "k int, body string").select("k", graph.mentions(F.col("body")).alias("m"))
    start = time.time()
    one, two = (r.m for r in df.orderBy("k").collect())
    assert set(one.repeals) == {"4000"} and [tuple(x) for x in one.amended_by] == [("9000", "500")] and not one.replaces
    assert not any(two) and time.time() - start < 15


def test_relationships_are_dealt_to_all_cores(spark):
    from tessera.plans import catalogue

    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert catalogue.QUERIES["relationship_infer"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_matches_are_summed_without_sorting_pairs(spark, tmp_path):
    import datetime

    from tessera.plans import catalogue

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, 7, "view", at, 95.0) for i in (0, 3, 12, 120, 119, 9, 10**18, 2**63 - 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["alert_match"](spark, str(tmp_path))
    keys = sorted(f"k{r[0]}" for r in rows)
    assert [tuple(r) for r in got.collect()] == [("u7", 8, keys[0], keys[-1])]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
