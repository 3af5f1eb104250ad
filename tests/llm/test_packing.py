"""Packing against the tokenizers library, and its windows on random pieces."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
LONG_WORDS = "x" * 300_000 + " " + "y z " * 30_000
ROWS = [(1, "One two three."), (2, "One two three."), (3, None), (4, ""), (5, " \n\t "), (7, "word"), (7, "word"), (8, LONG_WORDS), (None, "no id"), (9, "é日本😀 １２３ don't <|endoftext|>! a<|endoftext|>"), (10, " " * 5000 + "a")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from tessera.llm.entries import vocabulary

    made = Tokenizer.from_file(vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


def proved(pieces, texts, library, window=1024):
    """Every id of every document lies in one piece, and every window is gapless and of an allowed length."""
    expected = [(d, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts]
    by_document, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_document[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
    made = defaultdict(list)
    for d, parts in by_document.items():
        for total in {p.doc_tokens for p in parts}:
            found = sorted((p for p in parts if p.doc_tokens == total), key=lambda p: p.start)
            covered = defaultdict(set)  # rows that share an id have the same places
            for p in found:
                covered[p.start].add((p.length, bytes(p.ids)))
            made[d].append((total, sum(p.length for p in found)))
    assert sorted((str(d), sum(n for _, n in v)) for d, v in made.items()) == sorted((str(d), sum(len(i) for e, i in expected if e == d)) for d in {e for e, _ in expected})
    ids_of = defaultdict(list)
    for d, ids in expected:
        ids_of[d].append(np.array(ids, dtype="<u4"))
    for d, parts in by_document.items():
        for p in parts:
            assert any(len(x) == p.doc_tokens and x[p.start : p.start + p.length].tobytes() == bytes(p.ids) for x in ids_of[d])
        if len(ids_of[d]) == 1:
            places = sorted((p.start, p.length) for p in parts)
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    padding = 0
    for parts in by_window.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(len(i) for _, i in expected)


def test_pack_equals_the_library(spark, library):
    from tessera.llm.entries import vocabulary
    from tessera.llm.packing import pack, sequences

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = pack(docs, vocabulary())
    padding, total = proved(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()], library)
    assert padding <= total / 200
    whole = sequences(pieces).collect()
    assert sum(r.length for r in whole) == total and all(len(r.ids) == 4 * r.length for r in whole)


def test_pack_edges_in_many_tasks(spark, library):
    from tessera.llm.entries import vocabulary
    from tessera.llm.packing import pack

    edges = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ROWS], "doc_id long, text string, ids string, part int, sequence_id int").repartition(5)
    pieces = pack(edges, vocabulary()).collect()
    padding, _ = proved(pieces, ROWS, library)
    assert padding == 0  # leftovers of all tasks end in windows of powers of two
    bare = pack(edges, vocabulary(), with_ids=False).collect()
    assert all(r.ids is None for r in bare) and sum(r.length for r in bare) == sum(r.length for r in pieces)
    assert pack(edges.limit(0), vocabulary()).count() == 0
    alone = pack(edges.where("doc_id = 4"), vocabulary()).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in alone] == [(0, 1, 1, 0)]
    with pytest.raises(ValueError):
        pack(edges, vocabulary(), window=1000)


def test_query_returns_the_dealt_columns(spark, library):
    from tessera.llm.entries import QUERIES

    got = QUERIES["op13_packing"](spark, SF)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and {t for _, t in got.dtypes} == {"bigint"}


def test_windows_hold_a_fixed_number_and_waste_little():
    from tessera.llm.packing import Windows

    random.seed(5)
    for tolerance in (0, 4):
        windows, sent = Windows(64, 5, tolerance), 0
        for k in range(3000):
            n = random.choice((1, 3, 17, 40, 63, 64, 65, 200))
            windows.add(k, np.arange(n, dtype=np.uint32))
            assert len(windows.room) <= 5 and windows.room == sorted(windows.room) and all(0 < f < 64 for f, _ in windows.room)
            sent += n
        left = windows.close()
        rest = sum(len(p[2]) for p in left)
        lengths = defaultdict(int)
        for name, at, p in windows.full:
            assert at == lengths[name]
            lengths[name] += len(p[2])
        assert rest < 64 and sum(lengths.values()) + rest == sent and all(64 - tolerance <= n <= 64 for n in lengths.values())
        windows.full, windows.emitted = [], 0
        windows.split(left)
        sizes = defaultdict(int)
        for name, _, p in windows.full:
            sizes[name] += len(p[2])
        assert sorted(sizes.values(), reverse=True) == [1 << b for b in range(6, -1, -1) if rest >> b & 1]


def test_best_fit_takes_the_least_room():
    from tessera.llm.packing import Windows

    windows = Windows(10, 2, 0)
    for k, n in enumerate((6, 8)):
        windows.add(k, np.zeros(n, dtype=np.uint32))
    windows.add("best", np.zeros(2, dtype=np.uint32))  # fits both, fills the second
    assert [p[0] for _, _, p in windows.full] == [1, "best"]
    windows.add("new", np.zeros(7, dtype=np.uint32))
    windows.add("none", np.zeros(5, dtype=np.uint32))  # fits neither: the fullest gets its head
    assert [(p[0], len(p[2])) for _, _, p in windows.full[2:]] == [("new", 7), ("none", 3)]
    assert [(p[0], p[1], len(p[2])) for _, name in windows.room for p in windows.held[name]] == [(0, 0, 6), ("none", 3, 2)]
