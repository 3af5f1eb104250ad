"""Items of whole texts against a loop over sentences and matches."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import extract, graph

ACTIONS = ["adopted", "passed", "reading", "rescinded", "amended", "deferred", "directed", "approved", "endorsed", "received", "referred", "denied"]
NUMBERED = re.compile(r"\bBylaw(?:\s+Amendment)?(?:\s+\d{4})?\s+(?:No\.?\s*)?(?P<number>\d{3,4}(?:\.\d+)*)", re.I)
RECORDS = [("4500", "Zoning title", "Land", None, 1), ("4500", "Zoning Bylaw 2011", "Land Use", "Planning", 2), ("7200", "", "Fees", "Finance", 3), ("4500.02", None, None, None, 4)]
DOCUMENTS = [
    ("a", "City of Somewhere Zoning Bylaw No. 4500 received third reading. Bylaw No. 4500.01 amends Zoning Bylaw 4500; it repeals Fees Bylaw 2019 No. 7200!\nCouncil approved the plan for the park.\nCouncil approved the plan for the park.", "2024-05-01"),
    ("b", "Bylaw 4500\nBylaw No. 4500.02 was adopted; Bylaw 999 too; see Bylaw 4500.02 again. Bylaw 7200 was repealed by Bylaw 7300 and Council directed staff.\nCouncil directed staff to report on the bylaw.", None),
    ("c", None, "2024-05-02"), ("d", "", "2024-05-02"), ("e", "short", "x"), ("f", "Council denied it. " + "x" * 5000 + " Bylaw 4500 adopted. " + "Bylaw 1234 " * 400, "2024-05-03"),
    ("a", "Bylaw No. 4500 was passed, for Ünïversal bylaw nO 4500. éBylaw 555 stays hidden. BYLAW AMENDMENT 2020 NO.777 SECOND READINGS", "2024-05-04"),
]


def sentences(body):
    out = []
    for line in (body or "").splitlines():
        line = " ".join(line.split())
        if len(line) < 12:
            continue
        kept = re.sub(r"\b(No|Nos|St|Mt|Dr|Mr|Ms)\.", lambda m: m.group(0)[:-1] + "<DOT>", line, flags=re.I)
        for part in re.split(r"(?<=[.!?])\s+", kept):
            part = " ".join(part.replace("<DOT>", ".").split())
            out += [x for x in (part[i : i + 2400].strip() for i in range(0, len(part), 2400)) if x]
    return out


def action_of(chunk):
    low = chunk.lower()
    for word in ACTIONS:
        if word in low:
            found = re.search(r"\b(first|second|third|three)\s+readings?\b", low) if word == "reading" else None
            return found.group(0).title() if found else word.title()
    return "Discussed"


def title_of(chunk, number, start):
    prefix = " ".join(re.split(r"[.!?;]", chunk[max(0, start - 180) : start])[-1].split()).strip("“”\" :-–—")
    title = " ".join(f"{prefix} Bylaw No. {number}".split())
    return title if 10 <= len(title) <= 240 else f"Bylaw {number}"


def expected():
    known = {n: (t, c, d) for n, t, c, d, _ in RECORDS}  # the last of equal numbers
    rows = {}
    for key, body, date in DOCUMENTS:
        for pos, chunk in enumerate(sentences(body)):
            found = list(NUMBERED.finditer(chunk)) if "bylaw" in chunk.lower() else []
            for m in found:
                number = m["number"]
                record = known.get(number) or known.get(number.split(".")[0])
                title = title_of(chunk, number, m.start())
                if record and title.lower() in (f"bylaw {number}", f"bylaw no. {number}"):
                    title = record[0] or title
                identity = f"bylaw|{date}|{number}|{action_of(chunk)}"
                row = ("Bylaw", number, number.split(".")[0], title, action_of(chunk), chunk[:700], *(record[1:] if record else (None, None)), bool(record))
                rows.setdefault((key, hashlib.sha256(identity.encode()).hexdigest()[:16]), []).append(((pos, m.start()), row))
            if chunk.startswith(tuple(text.MOTION_OPENINGS)) and "bylaw" not in chunk.lower():
                identity = f"motion|{date}|{chunk.lower()}"
                row = ("Motion", None, None, chunk[:180], action_of(chunk), chunk[:700], None, None, False)
                rows.setdefault((key, hashlib.sha256(identity.encode()).hexdigest()[:16]), []).append(((pos, -1), row))
    return {k: min(v, key=lambda x: x[0])[1] for k, v in rows.items()}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, b, d, "Audit panel", "minutes", f"local/{k}.pdf", "chunk", 1) for k, b, d in DOCUMENTS], "key string, body string, date string, meeting_title string, source_kind string, local_path string, chunk string, pos int")
    records = spark.createDataFrame(RECORDS, "number string, title string, category string, department string, pos int")
    return extract.items(docs, records, "key", "body", "pos")


def test_items_equal_the_loop(found):
    got = {(r.key, r.id): (r.type, r.number, r.base_number, r.title, r.action, r.summary, r.category, r.department, r.matched_bylaw) for r in found.collect()}
    assert got == expected() and len(got) > 12


def test_items_have_all_fields(found):
    assert set(found.columns) == {
        "key", "id", "date", "meeting_title", "meeting_group", "meeting_url", "type", "number", "base_number", "relationships", "relationship_targets", "title", "action", "summary", "category", "department",
        "matched_bylaw", "bylaw_detail_url", "source_kind", "source_document_url", "local_document", "source_text",
    }
    rows = {(r.key, r.number, r.action): r for r in found.collect()}
    amending = rows["a", "4500.01", "Discussed"]
    assert amending.relationships.amends == ["4500"] and amending.relationships.repeals == ["7200"] and amending.relationship_targets == ["4500", "7200"]
    assert amending.matched_bylaw and amending.bylaw_detail_url == "bylaws/detail.html?number=4500" and amending.category == "Land Use"
    assert rows["b", "7200", "Directed"].relationships.repealed_by == ["7300"]
    exact = rows["b", "4500.02", "Adopted"]
    assert exact.matched_bylaw and exact.category is None and exact.title == "Bylaw No. 4500.02"  # the exact record counts, though it knows nothing
    assert {r.meeting_group for r in rows.values()} == {"panel"} and {r.local_document for r in rows.values()} == {"local/a.pdf", "local/b.pdf", "local/f.pdf"}
    motion = next(r for r in rows.values() if r.type == "Motion")
    assert motion.relationships is None and motion.bylaw_detail_url is None


def test_match_places_are_those_of_the_loop(spark):
    bodies = [b for _, b, _ in DOCUMENTS if b] + ["Bylaw 100Bylaw 200", "x", "日本 Bylaw 100 é Bylaw 2000"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for r in df.select("b", text.match_places(F.col("b"), text.REFERENCE).alias("m")).collect():
        assert [(m.at - 1, m.text) for m in r.m] == [(m.start(), m.group(0)) for m in NUMBERED.finditer(r.b)]


def test_repeated_records_dont_multiply_rows(spark):
    rows = spark.createDataFrame([("1", "x"), ("9", "1"), ("7", "8")], "k string, b string")
    records = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "key string, v string, pos int")
    got = {r.k: (r.v, r.matched) for r in extract.two_key_lookup(rows, records, "k", "b", "key", "v", "pos").collect()}
    assert got == {"1": ("new", True), "9": ("new", True), "7": (None, False)}
    edges = spark.createDataFrame([("1", "2", "amends")], "source string, target string, type string")
    names = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("2", None)], "key string, title string")
    assert [tuple(r) for r in graph.enrich(edges, names, "key", "title").select("source_title", "target_title", "target_collected").collect()] == [("b", "c", True)]


def test_first_value_goes_by_type(spark):
    df = spark.createDataFrame([(0, "0", False, [], 5), (2, "", True, [1], 5), (None, None, None, None, 5)], "n int, s string, b boolean, l array<int>, rest int")
    pick = lambda *c: [r[0] for r in df.select(text.first_value(df, *c)).collect()]
    assert pick("n", "rest") == [5, 2, 5] and pick("s") == ["0", None, None] and pick("b") == [None, True, None] and pick("l") == [None, [1], None]
