"""Fill-in-the-middle transformation over an index of distinct texts.

Texts move once, to where equal ones meet: they are dealt by ranges of (hash, id), so that a large group of copies is
spread over several tasks, and sorted so that copies stand together. The index entry of a text is made at the first of its
copies and looked up by the text itself, never by its hash alone: an entry holds the ends of the text's units as an
Elias-Fano list (about two bits and the logarithm of the mean unit's length for each unit), in code points. Every document
then draws its two cuts and its form from a keyed hash of its id, and selects the two ends from the list of its
text; documents with equal texts are cut in different places without their texts being looked at again.

Defined results: null and empty texts have no units and stay plain, as do texts that hold a marker, for which the
transformed text could not be told apart; the seed of a null id is that of an empty number; rows that share an id and a
text are cut alike; texts of any length are cut whole; an empty table gives an empty one. Columns other
than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import column, small

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")


class EliasFano:
    """An ascending list of numbers up to ``limit``: the low bits of each, and the high parts in unary."""

    def __init__(self, values: np.ndarray, limit: int):
        n = len(values)
        self.n, self.width = n, max(0, (limit // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        low = values & ((1 << self.width) - 1)
        self.low = np.packbits((low[:, None] >> np.arange(self.width)) & 1)
        high = np.zeros(n + (limit >> self.width) + 1, dtype=bool)
        high[(values >> self.width) + np.arange(n)] = True
        self.high = np.packbits(high)

    @classmethod
    def loads(cls, data: bytes, n: int, limit: int) -> EliasFano:
        made = cls(np.zeros(0, dtype=np.int64), 0)
        made.n, made.width = n, max(0, (limit // n).bit_length() - 1) if n else 0
        at = (n * made.width + 7) // 8
        made.low, made.high = np.frombuffer(data[:at], dtype=np.uint8), np.frombuffer(data[at:], dtype=np.uint8)
        return made

    def dumps(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes()

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        byte = int(np.searchsorted(ones, i, side="right"))
        rest = i - (int(ones[byte - 1]) if byte else 0)
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[rest])
        first, end = i * self.width, (i + 1) * self.width
        bits = np.unpackbits(self.low[first // 8 : (end + 7) // 8])[first % 8 : first % 8 + self.width]
        return (place - i) << self.width | int(bits @ (1 << np.arange(self.width)))


def line_ends(text: str) -> np.ndarray:
    """Ends, in code points, of the lines of a text; the last line may lack its line feed."""
    points = np.frombuffer(text.encode(), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if not text or text[-1] == "\n" else np.append(ends, len(text))


def draws(seed: int, key: object) -> tuple[int, ...]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def render(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text that was transformed: its parts hold no markers, so the first of each is the one that was set."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(PREFIX) :].partition(SUFFIX)
        suffix, _, middle = rest.partition(MIDDLE)
    else:
        suffix, _, rest = output[len(SUFFIX) :].partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


def _by_text(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Documents with equal texts side by side; large groups of copies span several partitions."""
    keyed = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    return keyed.repartitionByRange("_hash", key).sortWithinPartitions("_hash", key)


def _entries(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[tuple[int, bytes]]]]:
    """Slices of sorted batches with their texts and each text's index entry (number of units, boundary list)."""
    now, known = None, {}
    for part in small(batches, text):
        texts, found = column(part, text).to_pylist(), []
        for mark, body in zip(column(part, "_hash").to_pylist(), texts):
            if mark != now:
                now, known = mark, {}
            if body not in known:  # compares whole texts
                ends = line_ends(body)
                known[body] = len(ends), EliasFano(ends, len(body)).dumps()
            found.append(known[body])
        yield part, texts, found


def index_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, n_chars, boundaries): every document with the Elias-Fano list of its text's line ends."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _entries(batches, text):
            arrays = [column(part, key), pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n", "n_chars", "boundaries"])

    return _by_text(docs, text, key).mapInArrow(run, f"`{key}` {kind}, n long, n_chars long, boundaries binary")


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, with_output: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output): ``rate`` of 100 documents are
    transformed, ``spm`` of 100 of them with the suffix first; ``output`` is null without ``with_output``.

    The parts are put together again from the output and its form before the second digest is taken.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _entries(batches, text):
            rows: list[list] = [[] for _ in range(6)]
            outputs = []
            for k, body, (n, entry) in zip(column(part, key).to_pylist(), texts, found):
                h = draws(seed, k)
                form, prefix, middle, output = "plain", None, None, body
                if body and h[2] % 100 < rate and not any(m in body for m in MARKERS):
                    ends = EliasFano.loads(entry, n, len(body))
                    a, b = (ends.select(c - 1) if c else 0 for c in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    form, prefix, middle = "spm" if h[3] % 100 < spm else "psm", a, b - a
                    output = render(form, body[:a], body[a:b], body[b:])
                whole = restore(form, output)
                for to, value in zip(rows, (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())):
                    to.append(value)
                outputs.append(output if with_output else None)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [column(part, key), *(pa.array(x, t) for x, t in zip(rows, kinds)), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])

    schema = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
    return _by_text(docs, text, key).mapInArrow(run, schema)


def oracle(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """DuckDB SQL for the digests of ``transform`` over documents."""
    draw = lambda i: f"CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y ELSE '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
