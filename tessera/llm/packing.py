"""Bounded-space online packing of tokenised documents into windows of equal length.

Each task reads its documents once, in order, and keeps a fixed number of open windows. A document's piece goes to the
open window that it leaves the least room in (best fit); when none has room, the fullest window is emitted: padded where
only ``tolerance`` places are free, else filled with the head of the piece, whose rest is placed anew. At its
end a task merges its own open windows into full ones, which leaves less than one window. These leftovers, of fewer than
``window`` tokens a task, are merged in groups of MERGED tasks; what remains of a group is cut into
windows whose lengths are powers of two and need no padding.

So nothing is shuffled but one leftover per task, and a document stays whole unless it is longer than a window or meets
the end of one. A task's result is written once, with its leftover, before the leftovers are merged: a lost
executor costs that task alone, and sequence ids hold the task's number, so that they never clash.

Defined results: null and empty texts have only the closing id; rows that share an id, or have none, are documents of
their own; texts of any length are encoded whole; an empty table gives no pieces. Columns other than
the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.batches import column, small
from tessera.llm.store import cut

WINDOW = 1024
#: Open windows of a task.
OPEN = 64
#: Free places of a window that are rather padded than filled by cutting a piece.
TOLERANCE = 4
#: The id that closes each document.
CLOSING = 0
#: Tasks whose leftovers are merged by one task: at most MERGED windows of tokens.
MERGED = 1024
#: Texts of more characters are encoded by the operator of ``bpe``, which is n log n in the length of a word.
LONG = 200_000
_PART = 1 << 33  # sequences of a task
_MERGED_PARTS = 1 << 29  # number of the first group of leftovers, above those of tasks

Piece = tuple[object, int, np.ndarray, int]  # document, ids before the piece, ids, ids of the document


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a vocabulary file; special strings are special ids. Loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = _load(path)
    return _LOADED[path]


_LOADED: dict[str, Callable[[str], np.ndarray]] = {}


def _load(path: str) -> Callable[[str], np.ndarray]:
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    exact = bpe.tokenizer(path)  # refuses files that ask for other steps
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {exact.bytes[i]: i for word, i in model["model"]["vocab"].items() if word not in special}
    merged = [i for i in exact.made.values()]
    if merged != sorted(merged):  # ids can't stand for ranks
        return lambda text: exact.encode_batch([text])[0].astype(np.uint32)
    fast = tiktoken.Encoding("vocabulary", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG:
            ids = exact.encode_batch([text])[0]
        elif any(x in text for x in special):
            ids = fast.encode(text, allowed_special="all")
        else:
            ids = fast.encode_ordinary(text)
        return np.asarray(ids, dtype=np.uint32)

    return encode


class Windows:
    """The open windows of a task; ``full`` gathers the pieces of emitted ones as (window, offset, piece)."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, tolerance: int = TOLERANCE):
        self.window, self.most, self.tolerance = window, most, tolerance
        self.room: list[tuple[int, int]] = []  # (free places, window), ascending
        self.held: dict[int, list[Piece]] = {}
        self.made = self.emitted = 0
        self.full: list[tuple[int, int, Piece]] = []

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for piece in pieces:
            self.full.append((self.emitted, at, piece))
            at += len(piece[2])
        self.emitted += 1

    def add(self, document: object, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.window:  # whole windows of its own
            self.emit([(document, start, ids[start : start + self.window], total)])
            start += self.window
        while start < total:
            start += self.place((document, start, ids[start:], total))

    def place(self, piece: Piece) -> int:
        """How many of the piece's ids have found a place."""
        document, start, ids, total = piece
        k = bisect_left(self.room, (len(ids), -1))
        if k < len(self.room):  # the one with the least room that is enough
            free, name = self.room.pop(k)
            self.held[name].append(piece)
            self._reopen(free - len(ids), name)
            return len(ids)
        if len(self.room) < self.most:
            self.made += 1
            self.held[self.made] = [piece]
            self._reopen(self.window - len(ids), self.made)
            return len(ids)
        free, name = self.room.pop(0)
        pieces, head = self.held.pop(name), 0
        if free > self.tolerance:
            head = free
            pieces.append((document, start, ids[:head], total))
        self.emit(pieces)
        return head

    def _reopen(self, free: int, name: int) -> None:
        if free:
            insort(self.room, (free, name))
        else:
            self.emit(self.held.pop(name))

    def close(self) -> list[Piece]:
        """Merge the open windows, fullest first; the pieces that are left fill less than one."""
        rest = [p for _, name in self.room for p in self.held[name]]
        self.room, self.held = [], {}
        return self.fill(rest)

    def fill(self, pieces: list[Piece]) -> list[Piece]:
        """Emit full windows of the pieces in their order; returns what is left."""
        now, free = [], self.window
        for document, start, ids, total in pieces:
            while len(ids) >= free:
                now.append((document, start, ids[:free], total))
                self.emit(now)
                start, ids, now, free = start + free, ids[free:], [], self.window
            if len(ids):
                now.append((document, start, ids, total))
                free -= len(ids)
        return now

    def split(self, pieces: list[Piece]) -> None:
        """Emit less than a window of pieces as windows whose lengths are powers of two."""
        n = sum(len(p[2]) for p in pieces)
        while pieces:
            self.window = 1 << (n.bit_length() - 1)
            n -= self.window
            pieces = self.fill(pieces)


def _table(found: list[tuple[int | None, int, Piece]], key: str, kind: pa.DataType, part: int, with_ids: bool) -> pa.RecordBatch:
    """Rows of (window, offset, piece); those without a window are left over and keep their ids."""
    ids = [np.ascontiguousarray(p[2], dtype="<u4").tobytes() for _, _, p in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for _, _, p in found], kind), pa.array([p[1] for _, _, p in found], pa.int64()), pa.array([len(p[2]) for _, _, p in found], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([p[3] for _, _, p in found], pa.int64()),
            pa.array([None if w is None else part * _PART + w for w, _, _ in found], pa.int64()), pa.array([at for _, at, _ in found], pa.int64()),
            pa.array([x if with_ids or w is None else None for x, (w, _, _) in zip(ids, found)], pa.binary()), pa.array([part] * len(found), pa.int64()),
        ],
        [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"],
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN, tolerance: int = TOLERANCE, closing: int | None = CLOSING, with_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece of every document.

    ``ids`` holds a piece's little-endian unsigned 32-bit ids, or null without ``with_ids``; ``closing`` is the id after each
    document, if any. ``path`` must be readable on every executor.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window's length must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
    last = np.zeros(0, dtype=np.uint32) if closing is None else np.array([closing], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, windows, arrow = encoder(path), TaskContext.get().partitionId(), Windows(window, open_windows, tolerance), None
        for some in small(batches, text):
            arrow = column(some, key).type
            for document, body in zip(column(some, key).to_pylist(), column(some, text).to_pylist()):
                windows.add(document, np.concatenate((encode(body or ""), last)))
            if windows.full:
                yield _table(windows.full, key, arrow, part, with_ids)
                windows.full = []
        if arrow is not None:
            rest, ends = windows.close(), [0]
            for p in rest:
                ends.append(ends[-1] + len(p[2]))
            yield _table([*windows.full, *((None, at, p) for at, p in zip(ends, rest))], key, arrow, part, with_ids)

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("offset", "ascending")])
        pieces = list(zip(rows[key].to_pylist(), rows["start"].to_pylist(), (np.frombuffer(x, dtype="<u4") for x in rows["ids"].to_pylist()), rows["doc_tokens"].to_pylist()))
        windows = Windows(window)
        windows.split(windows.fill(pieces))
        return pa.Table.from_batches([_table(windows.full, key, rows[key].type, _MERGED_PARTS + group[0].as_py(), with_ids)])

    packed = cut(docs.select(key, text).mapInArrow(run, schema), "packed")
    left = packed.where("sequence_id IS NULL").withColumn("_group", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("_group").applyInArrow(merge, schema)
    return packed.where("sequence_id IS NOT NULL").unionByName(merged).drop("part")


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, length, documents, ids): the windows put together, at most a window of ids and pieces each."""
    each = F.array_sort(F.collect_list(F.struct("offset", key, "ids")))
    gathered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), each.alias("_p"))
    whole = F.aggregate("_p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return gathered.select("sequence_id", "length", F.transform("_p", lambda p: p[key]).alias("documents"), whole.alias("ids"))
