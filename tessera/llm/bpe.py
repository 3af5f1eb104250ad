"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match over the vocabulary. The guess is the BPE
result exactly when every adjacent pair of tokens is compatible, that is when merging the bytes of the
two tokens by the merge ranks gives the two tokens again; this is tested for all pairs of a batch at
once by undoing merges in numpy. Only words with an incompatible pair are merged step by step.

Defined results: null and empty texts have no tokens; the special string is one token wherever it
occurs; words of any length are handled (exact merging uses a heap and is n log n). Vocabulary files with
other steps than these (a normalizer, another splitting, special tokens with conditions) are refused.
Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.batches import column, gather, give_back, small

#: Fixed value: how the byte-level scheme cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts all below this code point are cut by an equivalent pattern with spelled-out classes, which the
#: standard library's matcher runs about twice as fast.
PLAIN_BELOW = 0x250
#: Words whose tokens a task remembers until it ends, besides those of one slice of a batch (4 MB of text); a cache, so results
#: don't depend on it.
REMEMBERED = 300_000
#: What a vocabulary file must say for the steps below to be the right ones.
SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes: themselves where printable, else characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_pattern() -> re.Pattern:
    """WORD_PATTERN for texts below PLAIN_BELOW: its classes as listed characters."""
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if regex.match(kind, chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Bpe:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self._check(model)
        alphabet, vocab = byte_alphabet(), model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.bytes[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.atom = {self.bytes[i][0]: i for i in vocab.values() if len(self.bytes[i]) == 1}
        # a merged token's rank is its place in the list; single bytes rank before all merges
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, dtype=np.int64)
        self.pair_rank_of: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank_of[a * size + b], self.made[rank] = rank, c
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, rank
        keys = np.array(list(self.pair_rank_of), dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array(list(self.pair_rank_of.values()))[order]
        self.size = size
        self.matcher = ahocorasick.Automaton()
        for i in vocab.values():
            if self.bytes[i] and self.bytes[i].decode("latin-1") not in self.special:
                self.matcher.add_word(self.bytes[i].decode("latin-1"), i)
        self.matcher.make_automaton()
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.place = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.words = regex.compile(WORD_PATTERN)
        self.plain_words, self.beyond_plain = plain_pattern(), re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._forget()

    @staticmethod
    def _check(model: dict) -> None:
        """Refuse files that ask for steps which aren't taken here."""
        splitting = model.get("pre_tokenizer") or {}
        odd = [k for k, v in SPLITTING.items() if splitting.get(k, v) != v] + [k for k, v in PLAIN_MODEL.items() if (model["model"].get(k) or None) != (v or None)]
        odd += ["normalizer"] * bool(model.get("normalizer")) + ["pre_tokenizer"] * (not splitting) + ["post_processor"] * ((model.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel")
        odd += [x["content"] for x in model["added_tokens"] if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized")]
        if odd:
            raise ValueError(f"the vocabulary file asks for other steps: {', '.join(odd)}")

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        # buffers that double when they are full, so that learning doesn't copy what is known each time
        self.known, self.known_at = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i] b[i] stay as they are when their bytes are merged by rank.

        Walks back through the merges that made the two tokens, latest first. At each step the tokens
        that touch the border must not themselves have a merge that would have come earlier.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), _NONE)  # merges of this rank or later don't cross any more
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)
            bad = crossing < limit[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            # undo the later of the two merges; equal ranks: the left one was made first
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~bad & (np.maximum(rx, ry) >= 0)]
        return good

    def merge_exactly(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        token = [self.atom[x] for x in data]
        if len(token) > 60:
            return self._merge_long(token)
        size, rank_of, late = self.size, self.pair_rank_of.get, 1 << 40
        ranks = [rank_of(a * size + b, late) for a, b in zip(token, token[1:])]
        while ranks:
            low = min(ranks)
            if low == late:
                break
            i = ranks.index(low)
            token[i] = made = self.made[low]
            del token[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(token[i - 1] * size + made, late)
            if i < len(ranks):
                ranks[i] = rank_of(made * size + token[i + 1], late)
        return token

    def _merge_long(self, token: list[int]) -> list[int]:
        """As merge_exactly, with a heap: n log n for words of any length."""
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.pair_rank_of.get(token[i] * self.size + token[j])) is not None:
                heapq.heappush(heap, (rank, i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words and remember their tokens."""
        if not words:
            return
        # byte 255 is in no UTF-8 text, so it can stand between words
        joined = b"\xff".join(w.encode() for w in words)
        tokens = np.fromiter((t for _, t in self.matcher.iter_long(joined.decode("latin-1"))), dtype=np.int64)
        gap = tokens == self.atom[255]
        owner = np.cumsum(gap)[~gap]
        tokens = tokens[~gap]
        sizes = np.bincount(owner, minlength=len(words))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[which]
        failing = np.unique(owner[inner[bad]])
        if len(failing):
            exact = [self.merge_exactly(words[k].encode()) for k in failing]
            kept = np.ones(len(words), dtype=bool)
            kept[failing] = False
            keep = kept[owner]
            owner = np.concatenate((owner[keep], np.repeat(failing, [len(x) for x in exact])))
            tokens = np.concatenate((tokens[keep], np.array([t for x in exact for t in x], dtype=np.int64)))
            order = np.argsort(owner, kind="stable")
            tokens, sizes = tokens[order], np.bincount(owner, minlength=len(words))
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words))))
        end = int(self.known_at[base])
        self.known = _with_room(self.known, end, len(tokens))
        self.known[end : end + len(tokens)] = tokens
        self.known_at = _with_room(self.known_at, base + 1, len(words))
        self.known_at[base + 1 : base + 1 + len(words)] = end + np.cumsum(sizes)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.index) > REMEMBERED:
            self._forget()
        pieces: list[tuple[int, list[str] | int]] = []
        new: set[str] = set()
        for k, text in enumerate(texts):
            for part in self.cut.split(text) if text and self.cut and any(s in text for s in self.special) else [text or ""]:
                if part in self.special:
                    pieces.append((k, self.special[part]))
                elif part:
                    found = (self.words if self.beyond_plain.search(part) else self.plain_words).findall(part)
                    pieces.append((k, found))
                    new |= set(found).difference(self.index)
        self.learn(list(new))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, piece in pieces:
            if isinstance(piece, int):
                out[k].append(np.array([piece], dtype=np.int32))
            else:
                at = np.fromiter(map(self.index.__getitem__, piece), dtype=np.int64, count=len(piece))
                out[k].append(self.known[gather(self.known_at[at], self.known_at[at + 1] - self.known_at[at])])
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return self.flat[gather(self.place[ids], self.length[ids])].tobytes().decode("utf-8", "replace")


def _with_room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, made larger if ``more`` values don't fit after the ``used`` ones."""
    if used + more <= len(values):
        return values
    out = np.zeros(2 * (used + more), dtype=values.dtype)
    out[:used] = values[:used]
    return out


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, text: str = "text", key: str = "doc_id", others: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, and the ids if asked for; with
    ``others``, after all other columns as they are but for those of these names.

    Map-only: nothing is shuffled. ``path`` must be readable on every executor.
    """
    kind = docs.schema[key].dataType
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = [c for c in docs.columns if c not in (key, *made)] if others else []

    def run(batches):
        bpe = tokenizer(path)
        for part in small(batches, text):
            rows = bpe.encode_batch(column(part, text).to_pylist())
            arrays = [
                column(part, key),
                pa.array([len(x) for x in rows], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in rows]),
            ]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *rows]).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([arrays[0], *[column(part, c) for c in kept], *arrays[1:]], [key, *kept, *names[1:]])
        bpe._forget()  # the worker may wait beside other stages
        give_back()

    schema = f"`{key}` {kind.simpleString()}" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(*dict.fromkeys([key, *kept, text])).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text of each list of ids."""
    kind = encoded.schema[key].dataType

    def run(batches):
        bpe = tokenizer(path)
        for part in batches:
            texts = [bpe.decode(np.asarray(x or [], dtype=np.int64)) for x in column(part, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind.simpleString()}, text string")
