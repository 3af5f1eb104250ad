"""The corpus operators against brute force, round trips, held-out accuracy and defined edge cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, "One two three four five six seven eight."), (2, "One two three four five six seven eight."), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "word"),
    (7, "word"), (8, "x" * 3000 + " " + "y " * 4000), (None, "a row without an id"), (9, "é日本😀 １２３ don't <|endoftext|>!"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in EDGES], "doc_id long, text string, lang string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    from tessera.llm.words import Words

    texts = ["Abc def abc", None, "", "def", "x" * 100_000 + " ABC", "\x0bdef\x0c"]
    words = Words(pa.array(texts))
    spelled = [w for t in texts for w in split(t)]
    assert len(words) == len(spelled) and list(np.diff(words.bounds)) == [len(split(t)) for t in texts]
    by_word = {}
    for w, h in zip(spelled, words.hash):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


# 1
def test_url_rules_and_reputation(spark):
    from tessera.llm import url_reputation as u
    from tessera.llm.entries import URL_RULES

    urls = ["https://A.example.com/en/7?x", "http://b.example.com/en/8#t", "https://example.net/de/8", "https://m.example.net/de/9", "ftp://q.org", None, "no scheme", "https://bad.org/x", "https://bad.org/y"] + ["https://bad.org/z"] * 30
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, True) for i in range(9, 39)] + [(0, False), (3, False), (4, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in u.judge_urls(pages, outcomes, URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(7)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("b.example.com", "/en/8", "com/en/", "block"), ("example.net", "/de/8", "example.net/de/8", "block"),
        ("m.example.net", "/de/9", "net/de/", "allow"), ("q.org", "", None, got[4].verdict), ("", "", None, got[5].verdict), ("", "", None, got[6].verdict),
    ]
    assert got[7].verdict == "block" and got[8].bad_mean > 0.9
    joined = u.match_rules(pages.withColumns({"host": u.url_host(F.col("url")), "path": u.url_path(F.col("url"))}), spark.createDataFrame(URL_RULES, "verdict string, rule string"))
    assert {r.page_id: r.rule for r in joined.collect()} == {i: r.rule for i, r in got.items()}
    assert u.judge_urls(pages.limit(0), outcomes, URL_RULES).count() == 0
    odd = spark.createDataFrame([(h,) for h in ("a.b.co.uk:80", "x.y.example.com", "10.0.0.1:8080", "co.uk", "com", "")], "h string")
    assert [tuple(r) for r in odd.select(u.registered_domain(F.col("h")), u.public_suffix(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("example.com", "com"), ("10.0.0.1", "10.0.0.1"), ("co.uk", "co.uk"), ("com", "com"), ("", "")]


def test_suffix_rules_go_by_depth(spark):
    from tessera.llm import url_reputation as u

    rules = ["uk", "co.uk", "*.ck", "!www.ck", "a.b.example", "io", "github.io"]
    given = {"X.Y.co.uk": ("y.co.uk", "co.uk"), "b.github.io": ("b.github.io", "github.io"), "github.io": ("github.io", "github.io"), "p.q.any.ck": ("q.any.ck", "any.ck"), "any.ck": ("any.ck", "any.ck"), "x.www.ck": ("www.ck", "ck"), "www.ck": ("www.ck", "ck"), "z.a.b.example": ("z.a.b.example", "a.b.example"), "m.n.org.": ("n.org", "org"), "ck": ("ck", "ck"), "EXAMPLE.com:8080": ("example.com", "com")}
    frame = spark.createDataFrame([(h,) for h in given], "h string")
    got = {r.h: (r.d, r.s) for r in frame.select("h", u.registered_domain(F.col("h"), rules).alias("d"), u.public_suffix(F.col("h"), rules).alias("s")).collect()}
    assert got == given


def test_planted_hosts_among_the_given_pages_are_blocked(spark):
    from tessera.llm import url_reputation as u
    from tessera.llm.entries import URL_RULES

    sf = "/root/testdata/sf0.01"
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    planted = spark.range(400).select((F.col("id") + 10**6).alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 4, F.lit(".bad.org/"), "id").alias("url"))
    bad = planted.select("page_id", (F.col("page_id") % 5 > 0).alias("bad"))
    got = u.judge_urls(pages.select("page_id", "url").unionByName(planted), outcomes.unionByName(bad), URL_RULES).where("rule IS NULL AND verdict = 'block'")
    assert {r.host for r in got.select("host").distinct().collect()} == {f"h{i}.bad.org" for i in range(4)} and got.count() == 400


def test_url_reputation_decides_pages(spark):
    from tessera.llm import url_reputation as u

    rng = random.Random(6)
    rows, bad = [], []
    for d in range(12):  # domain 3 is bad as a whole, host 0 of domain 5 alone
        for h in range(4):
            rate = 0.7 if d == 3 or (d == 5 and h == 0) else 0.1
            for _ in range(60):
                rows.append((len(rows), f"https://h{h}.d{d}.co.uk/x", "kept", 1.0))
                if len(rows) % 3:
                    bad.append((len(rows) - 1, rng.random() < rate))
    rows.append((len(rows), "https://new.d3.co.uk/", "kept", 1.0))  # no outcome of its own: its domain decides
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bad_mean double")
    rules = [("block", f"r{i}.example/p") for i in range(20_000)] + [("allow", "h1.d3.co.uk/")]
    got = u.judge_urls(pages, spark.createDataFrame(bad, "page_id long, bad boolean"), rules)
    assert sorted(got.columns) == sorted(set(got.columns))
    blocked = {r.host for r in got.where("verdict = 'block'").collect()}
    assert blocked == {"h0.d3.co.uk", "h2.d3.co.uk", "h3.d3.co.uk", "h0.d5.co.uk", "new.d3.co.uk"}


# 2
def test_line_dedup(spark, edges, empty):
    from tessera.llm import line_dedup as d

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"alpha\n{long}\nomega"), (2, f"other\n{long}\nend"), (3, f"{long}\n{long}"), (4, "short\nshort"), (5, None), (6, "short\nshort")]
    got = {r.doc_id: r for r in d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "other\nend" and got[3].text == "" and got[4].text == got[6].text == "short\nshort" and got[5].text is None
    assert d.dedup_lines(edges).count() == len(EDGES) and d.dedup_lines(empty).count() == 0


def test_line_dedup_finds_every_passage_of_over_50_words(spark):
    from tessera.llm import line_dedup as d

    rng = random.Random(31)
    line = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    common = line(9)  # a line that many texts have, of which none goes
    passages = []
    for k in range(40):
        left, lines = 51 + k, []
        while left > 0:
            lines.append(line(min(left, rng.choice([3, 8, 13, 30, 60]))))
            left -= len(lines[-1].split())
        passages.append("\n".join(lines))
    rows, own = [], {}
    for i in range(160):
        p = passages[i % 40]
        before, after = ([line(rng.randint(1, 40)) for _ in range(rng.randint(0, 3))] + [common, line(5)] for _ in range(2))
        after.reverse()
        rows.append((i, "\n".join([*before, p, *after])))
        own[i] = {w for x in (*before, *after) for w in x.split()}
    frame = spark.createDataFrame([(i, t, str(i), i, -i) for i, t in rows], "doc_id long, text string, _units string, _gone long, h long")
    out = d.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_removed"]
    for r in out.collect():
        p = passages[r.doc_id % 40]
        assert (p in r.text) == (r.doc_id < 40) and common in r.text and (r._units, r._gone, r.h) == (str(r.doc_id), r.doc_id, -r.doc_id)
        if r.doc_id >= 40:
            assert not set(r.text.split()) & (set(p.split()) - own[r.doc_id]) and own[r.doc_id] == set(r.text.split())


# 3
def test_bpe_equals_the_library(spark, docs, edges, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    rng = random.Random(5)
    texts = [x for _, x in EDGES] + ["".join(rng.choice("abcdehtinso ré'1\n") for _ in range(rng.randint(1, 90))) for _ in range(3000)] + [r.text for r in docs.collect()]
    mine = bpe.Bpe(path)
    for ids, text in zip(mine.encode_batch(texts), texts):
        expected = t.encode(text or "", add_special_tokens=False).ids
        assert list(ids) == expected
        assert mine.decode(ids) == t.decode(expected, skip_special_tokens=False)
    model = json.load(open(path, encoding="utf-8"))
    for other in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": model["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.Bpe._check(model | other)
    table = bpe.encode_documents(edges, path, with_ids=True)
    back = bpe.decode_documents(table, path).join(edges.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    assert all(r.text == (r.was or "") for r in back) and bpe.encode_documents(empty, path).count() == 0


# 4
KEY = "a key"


def pseudonym(kind, x):
    """What op 4 puts in place of a value, written anew."""
    import datetime

    def bits(value, tweak):
        return int(hashlib.sha256(f"{KEY}|{tweak}|{value}".encode()).hexdigest()[:12], 16)

    def digits(d, tweak):
        a, b = d[: len(d) // 2], d[len(d) // 2 :]
        for i in range(1, 9):
            a, b = b, str((int(a) + bits(b, f"{tweak}{i}")) % 10 ** len(a)).zfill(len(a))
        return a + b

    def below(n, size, tweak, valid=lambda t: True):
        half = 1 << size // 2
        while True:
            a, b = divmod(n, half)
            for i in range(1, 9):
                a, b = b, (a + bits(b, f"{tweak}{i}")) % half
            n = a * half + b
            if valid(n):
                return n

    def refill(new):
        new = iter(new)
        return "".join(next(new) if c.isdigit() else c for c in x)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10

    d, first = re.sub("[^0-9]", "", x), datetime.date(1900, 1, 1)
    if kind == "card":
        body = d[:6] + digits(d[6:-1], "card" + d[:6]) if luhn(d) == 0 and int(d) else None
        return refill(body + str(-luhn(body + "0") % 10)) if body else x
    if kind == "ip":
        o = [int(c) for c in x.split(".")]
        n = below(int.from_bytes(bytes(o), "big"), 32, "ip") if max(o) < 256 else None
        return x if n is None else ".".join(str(b) for b in n.to_bytes(4, "big"))
    if kind == "date":
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
            try:
                n = (datetime.datetime.strptime(x, form).date() - first).days
            except ValueError:
                continue
            at = lambda t: first + datetime.timedelta(t)
            if not 0 <= n < 65536:
                return x
            return at(below(n, 16, "month first", lambda t: at(t).day > 12) if form == "%m/%d/%Y" else below(n, 16, "date")).strftime(form)
        return x
    if kind == "phone":
        if re.match("[+][2-9]", x):
            return refill(d[:2] + digits(d[2:], "phone" + d[:2])) if 8 <= len(d) <= 15 else x
        area, exchange = int(d[-10:-7]), int(d[-7:-4])
        if not area or not exchange:
            return x
        n = below(((area - 1) * 999 + exchange - 1) * 10000 + int(d[-4:]), 34, "phone", lambda t: t < 999 * 999 * 10000)
        return refill(f"{d[:-10]}{n // 9990000 + 1:03}{n // 10000 % 999 + 1:03}{n % 10000:04}")
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return x
        n = below(((area - (1 if area < 666 else 2)) * 99 + group - 1) * 9999 + serial - 1, 30, "ssn", lambda t: t < 898 * 99 * 9999)
        area = n // (99 * 9999)
        return refill(f"{area + (1 if area < 665 else 2):03}{n // 9999 % 99 + 1:02}{n % 9999 + 1:04}")
    if kind == "iban":
        p = x.replace(" ", "")
        rest = lambda q: int("".join(str(int(c, 36)) for c in q[4:] + q[:4])) % 97
        own = re.sub("[^0-9]", "", p[4:])
        if rest(p) != 1 or not "02" <= p[2:4] <= "98" or not 2 <= len(own) <= 30:
            return x
        new = iter(digits(own, "iban" + p[:2] + re.sub("[0-9]", "#", p[4:])))
        q = p[:2] + "00" + "".join(next(new) if c.isdigit() else c for c in p[4:])
        q = iter(q[:2] + f"{98 - rest(q):02}" + q[4:])
        return "".join(c if c == " " else next(q) for c in x)
    keyed = lambda what: hashlib.sha256(f"{KEY}|{kind}|{what}".encode()).hexdigest()
    if kind == "email":
        return f"user-{keyed(x.lower())[:16]}@mail.invalid"
    value = re.search(r"[A-Za-z0-9+/_.-]+$", x)[0]
    return x[: -len(value)] + (keyed(value) * (len(value) // 64 + 1))[: len(value)]


def test_pii_against_brute_force(spark):
    from tessera.llm import pii

    anything, patterns = re.compile(pii.ANY), {k: re.compile(p) for k, p in pii.PATTERNS.items()}
    seen = []

    def replaced(m):
        kind = next(k for k, p in patterns.items() if p.fullmatch(m[0]))
        out = pseudonym(kind, m[0])
        if out != m[0]:
            seen.append(kind)
        return out

    rng = random.Random(17)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n):
        body = d(n - 1)
        return next(body + c for c in "0123456789" if sum(int(y) if i % 2 == 0 else sum(divmod(2 * int(y), 10)) for i, y in enumerate(reversed(body + c))) % 10 == 0)

    def blocks(x, *sizes):
        return rng.choice(" -").join(x[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    make = [
        lambda: card(rng.choice([13, 16, 19])), lambda: blocks(card(16), 4, 4, 4, 4), lambda: blocks(card(15), 4, 6, 5), lambda: d(16), lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1890, 2090)}-{rng.randrange(14):02}-{rng.randrange(33):02}", lambda: f"{rng.randrange(1, 32):02}/{rng.randrange(1, 32):02}/{rng.randrange(1900, 2079)}", lambda: f"{rng.randrange(1, 32):02}.{rng.randrange(1, 13):02}.1999",
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 {d(10)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"+49{d(9)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: "000-12-3456", lambda: "000 000 0000", lambda: "DE89 3704 0044 0532 0130 00", lambda: "GB29NWBK60161331926819",
        lambda: "ES91 2100 0418 4502 0005 1332 PAGE", lambda: "4111 1111 1111 1111 12/27", lambda: "4111111111111111 345 Main", lambda: f"x{d(2)}@mail{d(1)}.example.com", lambda: f'token = "{d(20)}abc"', lambda: f"password: {d(rng.randrange(190, 400))}", lambda: f"{'l' * rng.randrange(60, 90)}@{'sub.' * rng.randrange(6, 14)}example.museum.", lambda: "plain words", lambda: d(5),
    ]
    rows = [(i, " ".join(f"{rng.choice(make)()} word" for _ in range(rng.randrange(8))), "kept", "kept") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _found string, pii string")
    out = pii.pseudonymise(frame, KEY)
    assert out.columns == ["doc_id", "text", "_found", "pii"]
    for r in out.collect():
        assert r.text == anything.sub(replaced, rows[r.doc_id][1]) and r._found == "kept"
    assert {*seen} == {*pii.PATTERNS} and len(seen) > 1000


def test_pii_permutations_are_one_to_one(spark):
    from tessera.llm import pii

    one = lambda df, kind: df.select(F.col("x"), F.expr(f"{pii._replacement('x', kind, KEY)}").alias("y"))
    day = F.expr(f"date_add({pii.FIRST_DAY}, cast(id AS int))")
    days = spark.range(65536)
    slashes = days.select(F.date_format(day, "dd/MM/yyyy").alias("x")).union(days.select(F.date_format(day, "MM/dd/yyyy"))).distinct()
    for dates in (slashes, days.select(F.date_format(day, "yyyy-MM-dd").alias("x")), days.select(F.date_format(day, "dd.MM.yyyy").alias("x"))):
        got = one(dates, "date").agg(F.count("*").alias("n"), F.countDistinct("y").alias("y"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("same")).first()
        assert got.n == got.y and got.same < 40  # with those outside of the window
        assert one(dates, "date").select("y").join(dates, F.col("x") == F.col("y"), "left_anti").count() == 0
    ssn = spark.range(20_000).select(F.expr("concat(lpad(cast(id % 1000 AS string), 3, '0'), '-', lpad(cast(id DIV 1000 AS string), 2, '0'), '-0001')").alias("x"))
    assert one(ssn, "ssn").select("y").distinct().count() == 20_000
    # one number, in whichever way it is written
    phones = spark.createDataFrame([(x,) for x in ("+1 743 555 3824", "+17435553824", "(743) 555-3824", "743.555.3824", "+1 7435553824")], "x string")
    assert {re.sub("[^0-9]", "", r.y)[-10:] for r in one(phones, "phone").collect()} != {"7435553824"} and one(phones, "phone").select(F.expr("right(regexp_replace(y, '[^0-9]', ''), 10)")).distinct().count() == 1
    short = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    assert short.select(F.expr(pii.feistel_digits("x", "key", "'t'")).alias("y")).distinct().count() == 1000


def test_pii_of_any_length_goes_whole(spark):
    from tessera.llm import pii

    long = ["api_key=" + "Zq9_" * 75, "secret: '" + "ab/" * 40_000 + "'", "x" * 100 + "@" + "a." * 5000 + "com", "me@" + ".".join(["deep"] * 12) + ".org, you@b.co.", "first.last+tag@" + "h" * 80 + ".travelersinsurance9"]
    rows = {r.i: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(long)), "i int, text string"), KEY).collect()}
    for i, left in enumerate(("Zq9_", "ab/", "a.a.", "deep", "first.last")):
        assert left not in rows[i].text and len(rows[i].pii) == (2 if i == 3 else 1)
    assert len(rows[0].text) == len(long[0]) and rows[1].text.endswith("'") and rows[3].text.endswith(".invalid.") and rows[2].text.endswith("@mail.invalid")


def test_pii_edges(spark, edges, empty):
    from tessera.llm import pii

    assert pii.pseudonymise(edges, KEY).count() == len(EDGES) and pii.pseudonymise(empty, KEY).count() == 0
    assert {r.doc_id: r.text for r in pii.pseudonymise(edges, KEY).collect()} == {i: t for i, t in EDGES}


# 5
def test_class_lm(spark, docs, edges, empty):
    from tessera.llm import class_lm

    texts = {r.doc_id: split(r.text) + [None] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in texts.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for r in class_lm.fit_and_score(docs).collect():
        t = texts[r.doc_id]
        expected = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, expected, rel_tol=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base
    assert class_lm.fit_and_score(edges).count() == len(EDGES) and class_lm.fit_and_score(empty).count() == 0


def test_class_lm_scores_against_brute_force(spark, monkeypatch):
    import pyarrow as pa

    from tessera.llm import class_lm
    from tessera.llm.words import Words

    for name, value in (("CLASSED", 110), ("SEED", 30), ("CLASSES", 3)):
        monkeypatch.setattr(class_lm, name, value)
    rng = random.Random(12)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]  # words of three kinds that take turns
    texts = [" ".join(rng.choice(kinds[(i + s) % 3]) if rng.random() < 0.95 else f"rare{rng.randrange(50)}" for i in range(rng.randint(0, 60))) for s in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = frame.where(~class_lm.held_out()).select("text")
    m = class_lm.fit(training, class_lm.word_counts(training))
    place = {int(h): i for i, h in enumerate(m.known)}
    of = lambda w: int(Words(pa.array([w])).hash[0])
    # words of a kind are in the same class, seed or not
    classed = {w: m.of[place[of(w)]] for k in kinds for w in k if of(w) in place}
    common = {k: Counter(c for w, c in classed.items() if w[0] == k) for k in "abc"}
    assert 60 < len(classed) <= 110 and sum(c.most_common(1)[0][1] for c in common.values()) > 0.9 * len(classed)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts, moves, size = Counter(), Counter(), m.classes + 2
    state = lambda w: int(m.of[place[of(w)]]) if of(w) in place else m.classes
    for i, t in enumerate(texts):
        if not held(i):
            counts.update(split(t))
            path = [m.classes + 1, *map(state, split(t)), m.classes + 1]
            moves.update(zip(path, path[1:]))
    n, into, away = sum(moves.values()), Counter(), Counter()
    for (a, b), c in moves.items():
        away[a] += c
        into[b] += c
    move = lambda a, b: math.log10((moves[a, b] + 2.0 * (into[b] + 0.5) / (n + 0.5 * size)) / (away[a] + 2.0))
    weight, rare = Counter(), Counter()
    for w, c in counts.items():
        (weight if of(w) in place else rare)[state(w)] += c
    left = sum(rare.values()) + 0.5 * (len(counts) - len(place) + 1)
    emit = lambda w: math.log10(counts[w] / weight[state(w)]) if of(w) in place else math.log10((counts[w] + 0.5) / left)
    for r in class_lm.fit_and_score(frame).collect():
        words = split(texts[r.doc_id])
        path = [m.classes + 1, *map(state, words), m.classes + 1]
        expected = sum(map(move, path, path[1:])) + sum(map(emit, words))
        assert math.isclose(r.score, expected, rel_tol=1e-9) and math.isclose(r.perplexity, 10 ** (-expected / (len(words) + 1)), rel_tol=1e-9)


def test_class_lm_has_a_class_for_every_word(spark, monkeypatch):
    import pyarrow as pa

    from tessera.llm import class_lm
    from tessera.llm.words import Words

    for name, value in (("NEAR", 40), ("SEED", 30), ("CLASSES", 3)):
        monkeypatch.setattr(class_lm, name, value)
    rng = random.Random(12)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]  # words of three kinds that take turns
    texts = [" ".join(rng.choice(kinds[(i + s) % 3]) if rng.random() < 0.9 else f"rare{rng.randrange(1500)}" for i in range(rng.randint(0, 60))) for s in range(300)]
    texts[7], texts[8] = "never1 seen1 a1 never1", "once1 once2 b3 once3"
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    training = frame.where(~class_lm.held_out()).select("text")
    m = class_lm.fit(training, class_lm.word_counts(training))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts, moves, size = Counter(w for i, t in enumerate(texts) if not held(i) for w in split(t)), Counter(), m.classes + 2
    of = lambda w: int(Words(pa.array([w])).hash.view(np.int64)[0])
    class_of = {int(h): int(k) for h, k in zip(m.known.view(np.int64), m.of)}
    far = {r.h: r for r in m.far.collect()}
    assert len(m.known) <= 40 and not far.keys() & class_of.keys() and {of(w) for w in counts} == far.keys() | class_of.keys()
    assert all(far[of(w)].c == c for w, c in counts.items() if of(w) in far)
    class_of |= {h: r["class"] for h, r in far.items()}
    assert set(class_of.values()) <= set(range(m.classes))
    common = {k: Counter(class_of[of(w)] for w in ws if w in counts) for k, ws in zip("abc", kinds)}  # far words of a kind join the near ones
    assert sum(c.most_common(1)[0][1] for c in common.values()) > 0.9 * 120 and len({c.most_common(1)[0][0] for c in common.values()}) == 3

    other, bound = m.classes, m.classes + 1
    state = lambda w: class_of.get(of(w), other) if w else bound
    states = lambda w: [state(w), other] if counts.get(w) == 1 else [state(w)]  # noqa: E731  a word seen once was unseen when it came
    for i, t in enumerate(texts):
        if not held(i):
            path = [None, *split(t), None]
            moves.update((a, b) for x, y in zip(path, path[1:]) for a in states(x) for b in states(y))
    n, into, away, weight = sum(moves.values()), Counter(), Counter(), Counter()
    for (a, b), c in moves.items():
        away[a] += c
        into[b] += c
    for w, c in counts.items():
        weight[state(w)] += c
    once = sum(c == 1 for c in counts.values())
    assert once > 100 and any(w not in counts for t in texts for w in split(t))
    move = lambda a, b: math.log10((moves[a, b] + 2.0 * (into[b] + 0.5) / (n + 0.5 * size)) / (away[a] + 2.0))
    emit = lambda w: math.log10(counts[w] / weight[state(w)]) if w in counts else math.log10(0.5 / (once + 0.5 * (once + 1)))
    total, v = sum(counts.values()) + sum(not held(i) for i in range(len(texts))), len(counts) + 1
    for r in class_lm.fit_and_score(frame).collect():
        words = split(texts[r.doc_id])
        path = [bound, *map(state, words), bound]
        expected = sum(map(move, path, path[1:])) + sum(map(emit, words))
        assert math.isclose(r.score, expected, rel_tol=1e-9) and math.isclose(r.perplexity, 10 ** (-expected / (len(words) + 1)), rel_tol=1e-9)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (v + 1))) for w in words) + math.log10((total - sum(counts.values()) + 0.5) / (total + 0.5 * (v + 1)))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_known == sum(w in counts for w in words) + 1


def test_class_lm_far_words_may_span_batches(spark):
    from tessera.llm import class_lm

    classes, size = 2, 5
    rng = random.Random(3)
    pairs = np.array([[0.0, 90.0], [90.0, 0.0]])
    rows = [(h, rng.choice((1, 2)) * size + rng.choice((0, 1, 2, 4)), None, 1) for h in (5, -9, 7, 7, 7, 11) for _ in range(700 if h == 7 else 3)] + [(12, 2 * size, None, 1)]
    steps = spark.createDataFrame(rows, "h long, code int, next long, c long")
    got = {}
    for n in (1, 10, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
        try:
            with pytest.MonkeyPatch.context() as p:
                p.setattr(class_lm, "cut", lambda df, *_: spark.createDataFrame(df.collect(), df.schema))
                placed = class_lm._place_far(steps, pairs, classes).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        totals = Counter()
        for r in placed:
            if r.h is None:
                totals[r.pair] += r.c
        got[n] = {(r.h, r["class"], r.c) for r in placed if r.h is not None}, totals
    assert got[1] == got[10] == got[10_000] and {(h, c) for h, _, c in got[1][0]} == {(5, 3), (-9, 3), (7, 2100), (11, 3), (12, 1)}


def test_exchange_finds_planted_classes():
    from tessera.llm.class_lm import exchange

    rng = np.random.default_rng(3)
    counts = np.zeros((20, 20))
    counts[:10, 10:] = rng.integers(5, 20, (10, 10))
    counts[10:, :10] = rng.integers(5, 20, (10, 10))
    of = exchange(counts, 2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


# 6
def components(rows):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    at = {i: i for i in sets}

    def find(a):
        while at[a] != a:
            a = at[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                at[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}, {i: [len(s) for s in x] for i, x in sets.items()}


def test_jaccard_join(spark, docs, edges, empty):
    from tessera.llm import jaccard

    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(words) for _ in range(40))
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 9, 11, 13, 30, 90, 200]))]
        for c in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (" " + passage if k % 5 == 0 else "")))
    big = [rng.choice(words) for _ in range(300)]
    for c in range(90):  # a group of near copies with heavy shingles
        copy = list(big)
        for _ in range(c % 7):
            copy[rng.randrange(300)] = rng.choice(words)
        rows.append((len(rows), " ".join(copy)))
    rows += [(i + 1000, t) for i, t in EDGES if i is not None]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected, sizes = components(rows)
    assert len(got) == len(rows)
    assert all(expected[r.doc_id] == r.component_id and r.n_shingles in sizes[r.doc_id] for r in got)
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.keep_one(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, None, 9}


def test_jaccard_join_of_short_texts(spark):
    from tessera.llm import jaccard

    # texts that share all but one shingle: 5/7 to 8/10 are below or just at the bound, by size
    rows = []
    for n in range(5, 16):
        words = [f"n{n}w{i}" for i in range(n)]
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((words[:-1] + ["x"], words[:-1] + ["y"], ["z"] + words[1:]))]
        if n % 2:
            rows.append((len(rows), " ".join(words[:-1])))
            rows.append((len(rows), " ".join(words[:-2])))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected, _ = components(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(set(expected.values())) < len(rows)


def test_jaccard_join_of_a_large_group_without_one_centre(spark):
    from tessera.llm import jaccard

    rng = random.Random(23)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    second = base[:60] + [rng.choice(words) for _ in range(30)] + base[90:]  # a family of its own within the group
    rows = []
    for c in range(260):
        copy = list(base if c % 3 else second)
        for _ in range(rng.randrange(11)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[rng.choice(words)], [], [rng.choice(words), rng.choice(words)]])
        rows.append((f"d{c:03}", " ".join(copy)))
    for c in range(40):  # chains: each differs a little from the one before
        tail = rows[-1][1].split() if c else list(base)
        tail[3 * c : 3 * c + 3] = [rng.choice(words) for _ in range(3)]
        rows.append((f"e{c:03}", " ".join(tail)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    expected, _ = components(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert 20 < len(set(expected.values())) < len(rows)


def test_size_bounds_are_exact():
    from tessera.llm import jaccard as j

    for m in range(1, 60):
        for k in range(max(1, m - 9), m + 9):
            for n in j.partner_sizes(m):
                for x in (j.most_apart(n, k) + 2, j.most_apart(n, k) + 4):
                    for d in range(m + k + 1):
                        if (d + m + k) % 2 == 0 and x <= n + k:
                            assert j.shared_differences(d, m, k) <= max(1, (x + d - j.most_apart(n, m) + 1) // 2)

    for n in range(1, 60):
        for m in range(n, 90):
            links = [o for o in range(0, n + 1) if 100 * o >= 80 * (n + m - o)]
            assert (m in j.partner_sizes(n)) == bool(links)
            if links:
                assert j.overlap(n, m) == links[0] and n - links[0] + 1 <= j.prefix_length(n)


# 7
def test_segments_against_brute_force():
    from tessera.llm.toxicity import segments

    def maximal(s, offset=0):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        _, _, i, j = best
        return maximal(s[:i], offset) + [(i + offset, j + offset)] + maximal(s[j:], offset + j)

    rng = random.Random(2)
    for _ in range(200):
        s = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 14))]
        assert sorted((a, b) for a, b, _ in segments(np.array(s))) == sorted(maximal(s))


def test_toxicity_against_brute_force(spark):
    import pyarrow as pa

    from tessera.llm import toxicity as x
    from tessera.llm.words import PUNCTUATION, Words

    rng = random.Random(19)
    plain, bad = [f"wörd{i}" for i in range(60)], [f"vile{s}" for s in ("", "s", "ly", "ness", "st")] + ["Grim", "grimly"]
    rows = []
    for i in range(900):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(2, 6) if toxic else rng.random() < 0.05):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, ", ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = x.fit(docs, labels)

    tokens = lambda s: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s))
    levels = lambda w: [w.encode()[:k] for k in x.PREFIXES] + [w.encode()]
    fold = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).collect()}
    counting = [(set(tokens(s)), y) for i, s, y in rows if i in fold]
    base = sum(y for _, y in counting) / len(counting)
    seen = [Counter() for _ in range(4)]
    toxic, parent = [Counter() for _ in range(4)], {}
    for words, y in counting:
        for k in range(4):
            for f in {levels(w)[k] for w in words}:
                seen[k][f] += 1
                toxic[k][f] += y
        for w in words:
            for k in range(1, 4):
                parent[k, levels(w)[k]] = levels(w)[k - 1]
    logit = lambda p: math.log(p / (1 - p))
    rate, score = {}, {}
    for k in range(4):
        for f, n in seen[k].items():
            if n >= x.LEAST_DOCS:
                prior = rate.get((k - 1, parent[k, f]), base) if k else base
                rate[k, f] = (toxic[k][f] + x.PRIOR * prior) / (n + x.PRIOR)
                odds, up = logit(rate[k, f]) - logit(base), logit(prior) - logit(base)
                if odds > x.SHIFT or up > x.SHIFT:
                    score[k, f] = min(max(odds, -2), 8) - x.SHIFT
    assert model.base == base and len(model.features) == len(score) > 5
    of = lambda w: [score[k, f] for k, f in enumerate(levels(w)) if (k, f) in score]
    for w in plain + [b.lower() for b in bad]:
        expected = of(w)[-1] if of(w) else x.UNKNOWN
        assert math.isclose(model.token_scores(Words(pa.array([w]), PUNCTUATION))[0], expected, rel_tol=1e-9)

    def maximal(s):
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        return maximal(s[: best[2]]) + [best[0]] + maximal(s[best[3] :]) if best[0] > 0 else []

    got = {r.doc_id: r for r in x.score(docs, model).collect()}
    for i, s, _ in rows[:150]:
        line = [of(w)[-1] if of(w) else x.UNKNOWN for w in tokens(s)]
        floor = math.log(model.k * max(len(line), 1))
        evidence = sum(max(0.0, model.lam * m - floor) for m in maximal(line))
        expected = 1 / (1 + math.exp(-(model.curve[0] * math.log1p(evidence) + model.curve[1])))
        assert math.isclose(got[i].score, expected, rel_tol=1e-6) and got[i].predicted == (expected >= 0.5)
    # the extreme-value scale is the root of E[exp(lambda * score)] = 1 over the tokens of clean documents
    clean = [of(w)[-1] if of(w) else x.UNKNOWN for i, s, y in rows if i not in fold and not y for w in tokens(s)]
    bins = [b / 4 + 0.125 for b in range(-16, 32)]  # each has a thousandth of a token besides
    total = sum(math.exp(model.lam * (math.floor(v * 4) / 4 + 0.125)) for v in clean) + sum(math.exp(model.lam * b) for b in bins) / 1000
    assert abs(total / (len(clean) + len(bins) / 1000) - 1) < 0.01


def test_toxicity(spark, edges, empty):
    from tessera.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    right, n, caught, toxic = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*"), F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic")).first()
    assert n > 200 and right > 0.97 and caught > 0.9 * toxic
    kept = toxicity.reject_toxic(edges, model)
    assert kept.schema == edges.schema and kept.count() == len(EDGES)
    assert toxicity.score(empty, model).count() == 0
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(edges, unlabelled).collect()} == {0.0}


# 8
def test_warc(spark):
    from tessera.llm import arc

    assert arc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    for version in (1, 2):
        content = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\nbody\n"
        _, (fields, back) = arc.parse_arc(arc.arc_file([("http://a.b/c", "1.2.3.4", "19990102", "text/html", content)], version))
        assert back == content and fields["URL"] == "http://a.b/c" and arc.warc_date(fields["Archive-date"]) == "1999-01-02T00:00:00Z"
    with pytest.raises(ValueError):
        list(arc.parse_arc(b"http://a.b 1.2.3.4 19990102 text/html 99\nshort"))
    rows = [(1, "http://x y/é", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "z" * 200_000), (7, "u", "é日本\n\r\n\r\n"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in arc.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == arc.digest(data)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 2, None: 2, 3: 4}
    assert arc.archive_pages(pages.limit(0)).count() == 0


def test_legacy_archives_of_any_content(spark, tmp_path):
    import gzip

    from tessera.llm import arc

    head = "HTTP/1.0 200 OK\r\nServer: caf\u00e9".encode("latin-1")
    latin, image = "caf\u00e9 \u00fc\r\n\r\nx".encode("latin-1"), bytes(range(256)) * 40 + b"\r\n\r\nWARC/1.1"
    records = [
        ("http://a.example/l", "1.2.3.4", "19970101120000", "text/html", head + b"\r\n\r\n" + latin), ("http://a.example/i", "1.2.3.4", "1997", "image/gif", b"HTTP/1.0 200 OK\r\n\r\n" + image),
        ("dns:a.example", "5.6.7.8", "19970101", "text/dns", b"19970101\na.example. 3600 IN A 1.2.3.4\n"), ("ftp://a.example/f", "1.2.3.4", "19970102", "text/plain", b"HTTQ"), ("metadata:about", "0.0.0.0", "19970103", "text/anvl", b"k: v"),
    ]
    for version in (1, 2):
        folder = tmp_path / str(version)
        folder.mkdir()
        (folder / "a.arc").write_bytes(arc.arc_file(records, version))
        (folder / "b.arc.gz").write_bytes(gzip.compress(arc.arc_file(records[:1], version)))
        got = arc.read_arc(spark, f"file://{folder}")
        assert {(r.kind, r.target, bytes(r.payload), r.content_type) for r in got.where("kind <> 'warcinfo'").collect()} == {
            ("response", records[0][0], latin, "application/http; msgtype=response"), ("response", records[1][0], image, "application/http; msgtype=response"),
            ("resource", records[2][0], records[2][4], "text/dns"), ("resource", records[3][0], records[3][4], "text/plain"), ("metadata", records[4][0], records[4][4], "text/anvl"),
        }
        info = got.where("kind = 'warcinfo'").first()
        assert got.count() == 8 and info.content_type == "text/plain" and bytes(info.payload).startswith(f"{version} 0 ".encode())
        assert bytes(got.where("target = 'http://a.example/l'").first().head) == head
        out = f"file://{tmp_path}/warc{version}"
        arc.write_warc(got, out)
        back = arc.read_warc(spark, out).collect()
        assert sorted((r.record_type, r.payload_digest, r.payload_bytes, r.warc_date) for r in back) == sorted((r.kind, r.payload_digest, r.payload_bytes, r.warc_date) for r in got.collect())


def test_records_without_page_ids_have_ids_of_their_own(spark, tmp_path):
    from tessera.llm import arc

    head = b"HTTP/1.0 200 OK\r\n\r\n"
    records = [("http://a.example/1", "1.2.3.4", "19970101", "text/html", head + b"same"), ("http://b.example/2", "1.2.3.4", "19980101", "text/html", head + b"same"), ("http://b.example/2", "1.2.3.4", "19980101", "text/html", head + b"same"), ("dns:a", "1.2.3.4", "19960101", "text/dns", b"same"), ("metadata:x", "0.0.0.0", "1999", "text/anvl", b"same")]
    (tmp_path / "a.arc").write_bytes(arc.arc_file(records, 1, "a.arc"))
    (tmp_path / "b.arc").write_bytes(arc.arc_file(records, 2, "b.arc"))
    parsed = arc.read_arc(spark, f"file://{tmp_path}").cache()
    arc.write_warc(arc.with_revisits(parsed), f"file://{tmp_path}/warc")
    back = arc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back) == 12  # two version records among them
    same = [r for r in back if r.payload_digest == arc.digest(b"same")]
    kept = [r for r in same if r.record_type == "response"]
    revisits = [r for r in same if r.record_type == "revisit"]
    assert len(kept) == 1 and len(revisits) == 7 and {r.refers_to_id for r in revisits} == {kept[0].record_id} and {r.payload_bytes for r in revisits} == {4}
    assert (kept[0].target, kept[0].warc_date) == ("http://b.example/2", "1998-01-01T00:00:00Z") and {r.record_type for r in same} == {"response", "revisit", "metadata"}


def test_archives_hold_many_pages(spark, tmp_path):
    import os

    from tessera.llm import arc

    docs = spark.read.parquet(f"{SF}/pages.parquet").coalesce(1)
    files = [list(arc.parse_arc(bytes(r.content))) for r in arc.pages_as_arc(docs).collect()]
    assert len(files) == 2 and sum(len(x) - 1 for x in files) == docs.count() and {x[0][1].split()[0] for x in files} == {b"1", b"2"}
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    got = {r.page_id: r for r in arc.archive_pages(docs).collect()}
    assert all(x.startswith("archived") for x in set(os.listdir(shared)) - before)  # archives and records are gone
    kept = {r.page_id: r for r in arc.archive_pages(docs, f"file://{tmp_path}/kept").collect()}
    assert len({r.record_id for r in kept.values()}) == docs.count() and os.path.isdir(tmp_path / "kept")
    assert {i: (r.record_type, r.refers_to, r.payload_digest) for i, r in got.items()} == {i: (r.record_type, r.refers_to, r.payload_digest) for i, r in kept.items()}
    assert all(r.refers_to_id == kept[r.refers_to].record_id for r in kept.values() if r.record_type == "revisit")


# 9
def fingerprint(text):
    """The selected (hash, place) pairs of a text, written anew."""
    import xxhash

    turned = lambda x, n: (x << n | x >> (64 - n)) & (1 << 64) - 1
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split("[ \t-\r]+", text.lower()) if w]
    grams = []
    for i in range(len(words) - 4):
        h = 0
        for w in words[i : i + 5]:
            h = turned(h, 7) ^ w
        grams.append(h >> 33)
    out = []
    for i in range(max(len(grams) - 15, min(len(grams), 1))):
        low = min(grams[i : i + 16])
        out.append((low, max(j for j in range(i, min(i + 16, len(grams))) if grams[j] == low)))
    return list(dict.fromkeys(out))


def test_winnowing(spark, edges, empty):
    from tessera.llm import winnow

    rng = random.Random(8)
    made = [(100 + i, " ".join(rng.choice(["ab", "C", "dé", "ef\n"]) for _ in range(rng.choice([0, 5, 6, 19, 20, 21, 40, 300])))) for i in range(60)]
    made[30:33] = [(130, made[29][1]), (131, made[29][1]), (131, "one two three four five six")]
    rows = made + [(i, t) for i, t in EDGES if i is not None and i != 7]
    got = winnow.fingerprint_edits(spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, _text string, _key long")).collect()
    assert len(got) == len(rows)
    unique = {(i, t or "") for i, t in rows}
    followers = {}  # documents of one id may stand in either order
    ordered = sorted({i for i, _ in unique}, reverse=True)
    texts = {i: sorted(t for j, t in unique if j == i) for i in ordered}
    for k, i in enumerate(ordered):
        for t in texts[i]:
            followers[i, t] = [x for x in texts[i] if x != t] + texts[ordered[(k + 1) % len(ordered)]]
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    show = lambda f: " ".join(f"{h:X}@{p:X}" for h, p in f)
    for r in got:
        fits = []
        for t in texts[r.doc_id]:
            for after in followers[r.doc_id, t]:
                half = len(t) // 2
                edited = t[: len(t) - half] + after[:half]
                own, changed, then = (fingerprint(x) for x in (t, edited, after))
                sets = [{h for h, _ in f} for f in (own, changed, then)]
                # texts of fewer than five words are one gram with a hash of another kind
                few = min(len(x.split()) for x in (t, edited, after)) < 5
                fits.append((r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()) and (few or (r.fingerprint, r.edited_fingerprint) == (show(own), show(changed)) and math.isclose(r.near_edited, likeness(*sets[:2])) and math.isclose(r.near_next, likeness(sets[0], sets[2]))))
        assert any(fits), r
    by_text = {}
    for r in got:
        for t in texts[r.doc_id]:
            if len(texts[r.doc_id]) == 1:
                assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert winnow.fingerprint_edits(edges).count() == len(EDGES) and winnow.fingerprint_edits(empty).count() == 0


def test_winnowing_order_in_parts(spark, monkeypatch):
    from tessera.llm import winnow

    monkeypatch.setattr(winnow, "PART_IDS", 7)
    ids = [3 * i * i for i in range(90)]
    frame = spark.createDataFrame([(i, False, i % 5, 0) for i in ids] + [(0, True, 1, 0)], "_key long, _null boolean, _rid long, _half int")
    got = {(r._key, r._rid): (r._next_key, r._next_rid) for r in winnow.next_ids(frame).collect()}
    order = [(i, i % 5) for i in sorted(ids, reverse=True)] + [(0, 1)]
    assert got == {x: order[(k + 1) % len(order)] for k, x in enumerate(order)}


# 10
def test_places_among_edges(spark):
    from tessera.llm.winnow import part_of

    for edges in ([], [3], [3, 5, 9], list(range(0, 200, 7))):
        got = spark.range(-2, 220).select("id", part_of("id", edges).alias("k")).collect()
        assert all(r.k == sum(e < r.id for e in edges) for r in got)


def test_decontamination(spark, edges, empty):
    from tessera.llm import decontam

    question = "If Alice walks 12 km to the old market and then buys 7 apples for her friend how many km are left"
    items = spark.createDataFrame([(1, question), (2, "tiny"), (3, None), (None, "x")], "item_id long, text string")
    again = question.replace("12", "90").replace("Alice", "Robert").replace("7", "15")
    mixed = "If Alice walks 12 km to the old market. Nothing else of the question is here at all, so it is clean text."
    rows = [(1, f"before {question} after"), (2, f"x {again} y"), (3, mixed), (4, None), (5, ""), (6, "plain words that have nothing to do with it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.judge(docs, items).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert {r.doc_id for r in decontam.decontaminate(docs, items).collect()} == {3, 4, 5, 6}
    assert decontam.judge(edges, items).count() == len(EDGES) and decontam.judge(empty, items).count() == 0
    assert decontam.decontaminate(edges, items.limit(0)).count() == len(EDGES)


def test_decontamination_in_any_case(spark):
    from tessera.llm import decontam

    question = "If Alice walks 12 km to the old Market and then Bob buys 7 apples for Carol how many km are left"
    other = "FIVE SMALL SHIPS LEAVE THE NORTHERN HARBOUR AT DAWN AND SAIL 40 MILES AGAINST THE WIND"
    items = spark.createDataFrame([(1, question), (2, other), (3, "Ann Bea Cleo Dora Eve Fay Gus Hal")], "item_id long, text string")
    rows = [
        (1, f"before {question.upper()} after", 1), (2, f"before {question.lower()} after", 1), (3, f"BEFORE {question.upper()} AFTER".replace("12", "95"), 1), (4, f"so {other.lower()} then", 2),
        (5, f"so {other} then", 2), (6, "with Ann Bea Cleo Dora Eve Fay Gus Hal again", 3), (7, "PLAIN WORDS THAT HAVE NOTHING TO DO WITH IT", None), (8, "with Ian Jo Kim Lea Mia Ned Ole Pia again", None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.item_id for r in decontam.judge(docs, items).collect()} == {r[0]: r[2] for r in rows}


def test_decontamination_judges_each_occurrence(spark):
    from tessera.llm import decontam

    question = "If Alice walks 12 km to the old market and then buys 7 apples for her friend how many km are left"
    series = "the red box holds 3 pens and the blue box holds 4 pens and the old box holds 5 pens and the new box holds 6 pens and the tin box holds 9 pens"
    items = spark.createDataFrame([(1, question), (2, series)], "item_id long, text string")
    again = [question.replace("12", str(20 + k)).replace("Alice", name).replace("7", str(50 + k)) for k, name in enumerate(["Robert", "Mary Ann", "Zoe", "Ida"])]
    chance = " ".join(f"then Eve{k} buys {k} apples for her son, walks {k} km to the old barn." for k in range(60))
    mixed = "If Alice walks 12 km to the old market. Nothing else of the question is here. Zoe walks 9 km to the old house and then buys 3 apples."
    rows = [(1, " ".join([question, *again])), (2, "; ".join(again)), (3, f"{chance} {question} {chance}"), (4, f"so {series} then"), (5, mixed), (6, chance)]
    got = decontam.judge(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r.doc_id: r.item_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 2, 5: None, 6: None}


def contaminated_by_hand(text, items):
    """The items that a text contains, by the definition of op 10, written anew; and the best of them."""
    import regex

    from tessera.llm import decontam as d

    def windows(text):
        """(place, [(window, slot values, literal words) of the template, the folded template and the words])"""
        flat = [x for x in re.split("[ \t-\r]+", text or "") if x]
        folded = ["#" if re.search("[0-9]", x) else x for x in flat]
        canon = ["@" if regex.match(r"\p{Lu}", x) else x for x in folded]
        plain = [x.lower() for x in flat]
        for tokens in (canon, folded):
            tokens[:] = [x.lower() for x in tokens]
            before = list(tokens)
            for i in range(1, len(tokens)):
                if before[i - 1] == "#" and any(before[i].startswith(u) and not re.match("[a-z]", before[i][len(u) :]) for u in d.UNITS):
                    tokens[i] = "~"
        n = len(flat)
        for p in range(n - 4 if n >= 5 else min(n, 1)):
            out = []
            for tokens in (canon, folded, plain):
                part = tokens[p : p + 5]
                out.append((tuple(part), tuple(x for x, y in zip(plain[p : p + 5], part) if y in "#@~" and tokens is not plain), sum(y not in "#@~" for y in part)))
            yield p, out

    seen = [(p, g, s) for p, ways in windows(text) for g, s in {(w[0], w[1]) for w in ways}]
    grams = {g for _, g, _ in seen}
    found = {}
    for item, question in items:
        rows = []  # folds, window, place, what matches it, its slots
        for q, (t, f, w) in windows(question):
            if t[2] >= 2:
                rows.append((False, ("t", t[0]), q, t[0], t[1]))
                if t[0] != f[0] and f[2] >= 2:
                    rows.append((False, ("t", t[0]), q, f[0], f[1]))
            rows.append((True, ("f", f[0]), q, f[0], f[1]) if f[2] >= 2 else (True, ("w", w[0]), q, w[0], ()))
        length = len((question or "").split())
        for folds in (False, True):
            mine = [r for r in rows if r[0] == folds]
            of = len({r[1] for r in mine})
            matched = {r[1] for r in mine if r[3] in grams}
            if not of or len(matched) < 0.8 * of:
                continue
            places = {}
            for _, w, q, g, theirs in mine:
                for p, h, own in seen:
                    if g == h and len(theirs) == len(own):
                        bucket = (p - q) // max(length // 2, 1)
                        for place in ((0, 0), (1, p - q), (2, bucket), (2, bucket - 1)):
                            there, tally = places.setdefault(place, (set(), {}))
                            there.add(w)
                            for was, is_ in zip(theirs, own):
                                tally.setdefault(was, Counter())[is_] += 1
            for there, tally in places.values():
                total = sum(sum(c.values()) for c in tally.values())
                if len(there) >= 0.8 * of and (not total or sum(max(c.values()) for c in tally.values()) / total >= 0.8):
                    found[item] = max(found.get(item, 0), len(matched) / of)
    return found, min(found, key=lambda i: (-found[i], i), default=None)


def test_decontamination_against_brute_force(spark):
    from tessera.llm import decontam

    rng = random.Random(41)
    words, names, units = [f"w{chr(97 + i)}x" for i in range(22)], ["Ann", "Bob,", "Carla", "Dan"], ["km", "apples", "hours.", "kg"]

    def token():
        x = rng.random()
        return rng.choice(names) if x < 0.15 else f"{rng.randrange(2, 90)} {rng.choice(units)}" if x < 0.35 else rng.choice(words)

    items = [(i, " ".join(token() for _ in range(rng.choice([2, 4, 6, 9, 14, 20])))) for i in range(25)] + [(90, "3 5 8 13 21 34"), (91, None), (92, "")]

    def variant(x):
        style, rename = rng.random(), {}
        out = [rename.setdefault(w, rng.choice(names) if w in names else str(rng.randrange(90))) if style > 0.5 and (w in names or w.isdigit()) else w for w in x.split()]
        if style < 0.2:
            out = [w.upper() for w in out]
        if 0.2 < style < 0.35:  # not consistent
            out = [str(rng.randrange(90)) if w.isdigit() else w for w in out]
        if rng.random() < 0.3 and out:
            out[rng.randrange(len(out))] = rng.choice(words)
        return " ".join(out)

    rows = []
    for i in range(220):
        parts = [" ".join(token() for _ in range(rng.randrange(25)))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            parts += [variant(rng.choice(items)[1] or ""), " ".join(token() for _ in range(rng.randrange(12)))]
        rows.append((i, "  ".join(parts), "kept"))
    out = decontam.judge(spark.createDataFrame(rows, "doc_id long, text string, _gram string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = {i: contaminated_by_hand(t, items) for i, t, _ in rows}
    for r in out.collect():
        found, best = expected[r.doc_id]
        assert (r.contaminated, r.n_items, r.item_id) == (bool(found), len(found), best), (rows[r.doc_id], found)
    assert 40 < sum(bool(f) for f, _ in expected.values()) < 200


def test_salted_join_of_frequent_keys(spark, monkeypatch):
    from tessera.llm import skew

    left = spark.createDataFrame([(i % 4 if i % 3 else 7, i) for i in range(600)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (7, "d"), (9, "e")], "k long, w string")
    rows = lambda df: sorted((str(r.k), r.v, str(r.w)) for r in df.select("k", "v", "w").collect())
    expected = {how: rows(left.join(right, "k", how)) for how in ("inner", "left")}
    for size in (5, 1000):
        monkeypatch.setattr(skew, "ROWS", size)
        for how in ("inner", "left"):
            assert rows(skew.salted_join(left, right, "k", how=how)) == expected[how]


def test_components(spark):
    from tessera.llm.components import connected_components

    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    at = {}
    find = lambda a: a if at.setdefault(a, a) == a else find(at[a])
    for a, b in links:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(a, a) == find(a) for a in at)


def test_pipeline_against_brute_force(spark, tmp_path):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from tessera.llm import line_dedup, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # planted: near copies, an empty text and a text that loses all its lines
    extra = docs.where("doc_id < 12 AND length(text) > 400").select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"), *docs.columns[2:])
    docs = docs.unionByName(extra.select(*docs.columns)).unionByName(spark.createDataFrame([(200_000, "", "en", None, 0), (200_001, None, "en", None, 0)], docs.schema))
    stage = dict(p.STAGES)

    def kept(name, frame):
        out = stage[name](spark, frame, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")

    clean = kept("toxicity", docs)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}

    deduped = kept("line_dedup", clean)
    expected = duckdb.sql(line_dedup.oracle(f"'{tmp_path}/toxicity/*.parquet'")).fetchall()
    assert {(r.doc_id, r.text) for r in deduped.collect()} == {(i, x) for i, x, n in expected if not n or x.strip(" ")}
    assert all(r.n_chars == len(r.text or "") for r in deduped.collect())

    unique = kept("jaccard_join", deduped)
    rows = [(r.doc_id, r.text) for r in deduped.collect()]
    of, _ = components(rows)
    assert {r.doc_id for r in unique.collect()} == {i for i, _ in rows if of[i] == i}

    pure = kept("decontamination", unique)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in pure.collect()} == {r.doc_id for r in unique.collect() if not contaminated_by_hand(r.text, items)[0]}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in pure.collect()}
    encoded = stage["bpe"](spark, pure, SF).collect()
    assert {r.doc_id: list(r.ids) for r in encoded} == {i: tokenizer.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in encoded) and len(encoded) < docs.count()
    assert {tuple(r[c] for c in docs.columns) for r in encoded} == {tuple(r) for r in pure.collect()}


def test_pipeline_run_leaves_only_what_it_returns(spark):
    import os

    import corpus_pipeline as p

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = p.run(spark, SF)
    left = set(os.listdir(shared)) - before
    assert out.count() > 100 and [x.split("-")[0] for x in left] == ["decontamination"]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


#: Names that operators use inside, of columns that documents may have.
CLASHES = ["_text", "_key", "_row", "id", "n", "h", "token", "score", "label", "component_id", "n_tokens", "ids", "host", "centre", "item_id", "kind", "held_out", "words", "rule", "payload", "toxic"]


def test_columns_with_clashing_names_change_nothing(spark):
    import corpus_pipeline as p
    from tessera.llm import bpe, class_lm, decontam, jaccard, toxicity
    from tessera.llm.entries import vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = docs.withColumns({c: F.lit("other") for c in CLASHES})
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    same = lambda run: sorted(map(str, run(docs).collect())) == sorted(map(str, run(clashing).collect()))
    assert same(lambda d: bpe.encode_documents(d, vocabulary(), with_ids=True))
    assert same(lambda d: class_lm.fit_and_score(d).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6)))
    assert same(jaccard.near_duplicates)
    assert same(lambda d: decontam.judge(d, benchmark))
    assert same(lambda d: toxicity.score(d, toxicity.fit(d, labels.where(~toxicity.held_out()))).select("doc_id", F.round("score", 6), "predicted"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns, name
        assert 0 < out.count() <= docs.count(), name


def test_pages_with_clashing_names_change_nothing(spark):
    from tessera.llm import arc, url_reputation
    from tessera.llm.entries import URL_RULES

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    clashing = pages.withColumns({c: F.lit("other") for c in [*CLASHES, "content", "source", "offset", "verdict", "path", "bad_mean", "bad", "domain"]})
    outcomes = spark.range(200).select(F.col("id").alias("page_id"), (F.col("id") % 3 == 0).alias("bad"))
    one, two = (url_reputation.judge_urls(d, outcomes, URL_RULES) for d in (pages, clashing))
    names = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, one.select(names).collect())) == sorted(map(str, two.select(names).collect()))
    kept = ["page_id", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, arc.archive_pages(pages).select(kept).collect())) == sorted(map(str, arc.archive_pages(clashing).select(kept).collect()))


def test_pipeline_stages_on_nothing(spark):
    import corpus_pipeline as p

    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def family_tests(spark, monkeypatch, n, own):
    """How many pairs the meeting of differences tests in a group of two families, and whether the components are right."""
    from tessera.llm import jaccard

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6):06}"
    base = [word() for _ in range(300)]
    other = list(base)
    for i in range(6):
        other[10 + i * 48] = word()
    rows = []
    for i in range(n):
        words = list(base if i % 2 else other)
        for _ in range(own):
            words[rng.randrange(300)] = word()
        rows.append((i, " ".join(words)))
    tested, met = [], jaccard._meetings

    def counted(one, two):
        a, b = (d.groupBy(*jaccard.MEETING).agg(F.count("*").alias(c)) for d, c in ((one, "n"), (two, "m")))
        tested.append(a.join(b, jaccard.MEETING).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0])
        return met(one, two)

    monkeypatch.setattr(jaccard, "_meetings", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    monkeypatch.setattr(jaccard, "_meetings", met)
    return tested[0], got, rows


@pytest.mark.parametrize("own", [2, 5])
def test_jaccard_join_of_two_families_is_exact_when_crowded(spark, monkeypatch, own):
    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "CROWD", 16)  # so that the order and the bands matter in a small group
    monkeypatch.setattr(jaccard, "MEETING_PART", 32)
    tested, got, rows = family_tests(spark, monkeypatch, 240, own)
    expected, _ = components(rows)
    assert got == expected


def test_jaccard_join_tests_few_pairs_of_a_large_group(spark, monkeypatch):
    small, _, _ = family_tests(spark, monkeypatch, 400, 5)
    large, _, _ = family_tests(spark, monkeypatch, 1200, 5)
    assert large < 4 * small  # all pairs would be nine times as many
