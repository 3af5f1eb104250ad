"""WARC: legacy ARC archives (versions 1 and 2) converted to WARC 1.1 records.

An ARC record is a header line, whose fields depend on the version named in the file's leading
``filedesc:`` record, and the number of bytes that the line declares. The converter synthesises what WARC
has and ARC lacks: record ids, ISO timestamps, record types, block and payload digests. An HTTP exchange
becomes a ``response`` with its head and payload, the version record a ``warcinfo``, a record of the scheme
``metadata:`` a ``metadata``, any other content (DNS answers, files) a ``resource`` with the content type that
ARC gives. Payloads and heads are bytes and stay as they are. A record's id is made of its file, its place there, its
address and its date, so that no two records share one. Equal payloads of responses and resources are stored
once: the record with the largest page id, or where none has one the latest, is kept, the others are ``revisit``
records that refer to its id.

WARC files are written by Spark's text writer (a record's end, two CRLF, is the line separator; the bytes
are written as they are) in files of bounded numbers of records by size, so of bounded size, and read back
as whole files.

Defined results: a null html is an empty payload, a null url becomes ``about:blank``, blanks and control
characters in a url are percent-encoded; a null page id never becomes the response of a group that has
an id; rows that repeat an id and a payload are all of the same type. An empty table gives no records. Other
columns of the pages are not looked at, whatever their names. An archive file is read as one value, so it may have 2 GB at
most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import column, small
from tessera.llm.skew import salted_join
from tessera.llm.store import cut, discard, new_path
from tessera.sources import files

#: The header fields of ARC records by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
PARSED = "page_id long, kind string, content_type string, target string, ip string, warc_date string, head binary, payload binary, payload_bytes long, payload_digest string, source string, offset long"
#: What identifies a record; its order decides which of equal payloads is kept.
IDENTITY = ["page_id", "warc_date", "source", "offset", "target"]
#: Bytes of pages in one archive file of ``pages_as_arc``, and files in an Arrow batch.
ARC_BYTES, ARC_FILES = 256 << 10, 64
#: Groups of equal payloads (some 60 bytes each) up to this count are broadcast.
FEW_GROUPS = 200_000
#: Records of up to so many payload bytes come to so many in a file at most, larger ones one by one: no file of
#: many records holds more than 128 MB of payloads.
FILE_SIZES = [(64 << 10, 2000), (1 << 20, 128), (16 << 20, 8), (1 << 62, 1)]


def digest(data: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, content) records."""
    about = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n".encode()
    parts = [_arc_line(f"filedesc://{name}", "0.0.0.0", "20200101000000", "text/plain", about, version, name, 0), about, b"\n"]
    for url, ip, date, kind, content in records:
        offset = sum(map(len, parts))
        parts += [_arc_line(url, ip, date, kind, content, version, name, offset), content, b"\n"]
    return b"".join(parts)


def _arc_line(url: str, ip: str, date: str, kind: str, content: bytes, version: int, name: str, offset: int) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return (" ".join(values[f] for f in ARC_FIELDS[version]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record, the leading version record first; the field ``at`` is its place."""
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").strip("\r")
        if end < 0 or not line.strip():
            at = (end if end >= 0 else len(data)) + 1
            continue
        values = line.split(" ")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes, {len(content)} are left")
        if line.startswith("filedesc:"):
            version = int(content.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            yield dict(zip(ARC_FIELDS[1], values)) | {"at": str(at)}, content
            fields = ARC_FIELDS[version]
        else:
            if len(values) != len(fields):
                raise ValueError(f"ARC header at byte {at} has {len(values)} fields, its version has {len(fields)}")
            yield dict(zip(fields, values)) | {"at": str(at)}, content
        at = end + 1 + length


def warc_date(arc_date: str) -> str:
    """20200131235959 -> 2020-01-31T23:59:59Z; shorter dates are filled up with their first moment."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(row: dict) -> str:
    """The id of a record of this identity."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row['source']}#{row['offset']} {row['warc_date']} {row['target']}')}>"


def _convert(contents: Iterator[bytes]) -> Iterator[list]:
    for data in contents:
        source = hashlib.sha1(data[:4096]).hexdigest()  # for files that don't name themselves
        for fields, content in parse_arc(data):
            url, head, payload, page = fields["URL"], b"", content, None
            if url.startswith("filedesc:"):
                source = url.removeprefix("filedesc:").lstrip("/")
            if content.startswith(b"HTTP/") and not url.startswith("filedesc:"):
                kind, content_type = "response", "application/http; msgtype=response"
                head, _, payload = content.partition(b"\r\n\r\n")
                page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head)
            else:
                kind = "warcinfo" if url.startswith("filedesc:") else "metadata" if url.startswith("metadata:") else "resource"
                content_type = fields["Content-type"]
            yield [int(page[1]) if page else None, kind, content_type, url, fields["IP-address"], warc_date(fields["Archive-date"]), head, payload, len(payload), digest(payload), source, int(fields["at"])]


def _as_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in PARSED.split(", ")])


def convert_arc(archives: DataFrame, content: str = "content") -> DataFrame:
    """The records of ARC files held in a binary column, as columns PARSED."""

    def run(batches):
        for part in small(batches, content):
            rows = list(_convert(x.as_py() for x in column(part, content)))
            if rows:
                yield _as_batch(rows)

    return archives.select(content).mapInArrow(run, PARSED)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Convert the ``.arc`` and ``.arc.gz`` files under a path."""

    def unpack(batches):
        for part in small(batches, "content"):
            yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x for x in column(part, "content").to_pylist()], pa.binary())], ["content"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arc*").load(path)
    return convert_arc(found.select("content").mapInArrow(unpack, "content binary"))


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """ARC files of many pages each: those of even ids are of version 1, the others of version 2."""

    def run(batches):
        made = 0
        for part in small(batches, "html", ARC_BYTES):
            records = {1: [], 2: []}
            for page_id, url, html in zip(column(part, "page_id").to_pylist(), column(part, "url").to_pylist(), column(part, "html").to_pylist()):
                payload = (html or "").encode()
                target = re.sub(r"[\x00-\x20\x7f\u0080-\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                records[1 + (page_id or 0) % 2].append((target, "192.0.2.1", "20200101000000", "text/html", head.encode() + payload))
            made += 1
            name = f"pages-{TaskContext.get().partitionId():06d}-{made:06d}"
            yield pa.RecordBatch.from_arrays([pa.array([arc_file(x, v, f"{name}-v{v}.arc") for v, x in records.items() if x], pa.binary())], ["content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "content binary")


def with_revisits(records: DataFrame) -> DataFrame:
    """Add ``refers``: the identity of the record that holds the same payload, for all that needn't be stored. ``records``
    is a written table.

    Of equal payloads the greatest by page id, date and place is kept, and all with its page id. Groups of one are left out of
    the join, which is by digest alone and deals frequent payloads to several tasks.
    """
    keys = records.where("kind IN ('response', 'resource')").select(*IDENTITY, F.concat_ws("/", "payload_digest", "payload_bytes").alias("_group"))
    groups = keys.groupBy("_group").agg(F.max(F.struct(*IDENTITY)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = cut(groups.select("_group", "_first"), "copies")
    keyed = records.withColumn("_group", F.when(F.col("kind").isin("response", "resource"), F.concat_ws("/", "payload_digest", "payload_bytes")))
    joined = salted_join(keyed, groups, "_group", keys.select("_group"), "left", FEW_GROUPS)
    same_place = (F.col("source") == F.col("_first.source")) & (F.col("offset") == F.col("_first.offset"))
    own = F.col("_first").isNull() | F.coalesce(F.col("page_id") == F.col("_first.page_id"), same_place & F.col("_first.page_id").isNull())
    out = joined.withColumn("refers", F.when(~own, F.col("_first"))).drop("_first", "_group")
    out._tessera_path = groups._tessera_path  # ``discard`` when it has been written
    return out


def _warc_bytes(row: dict) -> bytes:
    refers = row["refers"]
    head = row["head"] + b"\r\n\r\n" if row["kind"] == "response" else b""
    block = head + row["payload"] if refers is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['kind'] if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(row)}",
        f"WARC-Date: {row['warc_date']}",
        f"WARC-Target-URI: {row['target']}",
        f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {row['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers)}", f"WARC-Refers-To-Target-URI: {refers['target']}", f"WARC-Refers-To-Date: {refers['warc_date']}", f"X-Payload-Length: {row['payload_bytes']}"]
        lines += [f"X-Refers-To-Page-Id: {refers['page_id']}"] * (refers["page_id"] is not None)
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (PARSED and, if there are revisits, refers) as ``.gz`` WARC files under ``path``, by classes of size."""
    if "refers" not in records.columns:
        records = records.withColumn("refers", F.lit(None).cast(records.select(F.struct(*IDENTITY)).schema[0].dataType))

    def run(batches):
        for part in small(batches, "payload"):
            yield pa.RecordBatch.from_arrays([pa.array([_warc_bytes(r) for r in part.to_pylist()], pa.binary())], ["value"])

    names = [x.split()[0] for x in PARSED.split(", ")]
    below = 0
    largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    for limit, n in FILE_SIZES:
        if below <= largest:
            # a string of any bytes: the cast keeps them and the writer passes them on
            lines = records.where(F.col("payload_bytes").between(below, limit)).select(*names, "refers").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
            lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/to-{limit}")
        below = limit + 1


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + len(RECORD_END)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, warc_date string, record_id string, refers_to_id string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ of the records under ``path``; block and payload digests are verified."""

    def run(batches):
        for part in small(batches, "content"):
            rows = []
            for data in column(part, "content").to_pylist():
                for fields, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't fit")
                    head, _, payload = block.partition(b"\r\n\r\n") if "application/http" in fields["Content-Type"] else (b"", b"", block)
                    page, own = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != own:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't fit")
                    size, other = int(fields["X-Payload-Length"]) if revisit else len(payload), fields.get("X-Refers-To-Page-Id")
                    rows.append([int(page[1]) if page else None, size, own, fields["WARC-Type"], int(other) if other else None, fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")])
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select("content").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages -> ARC -> WARC files -> what is read back from them (READ). The files stay if a ``path`` is given; else they lie in
    the shared folder until they are read."""
    spark = pages.sparkSession
    place = path or new_path(spark, "warc")
    # parsed once; the version records of the ARC files are no pages
    records = cut(convert_arc(pages_as_arc(pages)).where("kind <> 'warcinfo'"), "records", ARC_FILES)
    linked = with_revisits(records)
    write_warc(linked, place)
    discard(linked)
    discard(records)
    back = read_warc(spark, place)
    if path:
        return back
    back = cut(back, "archived")
    files.delete(spark, place)
    return back
