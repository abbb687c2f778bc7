"""WARC in ZIP-packaged archives: writer, directory parser and range reader.

An archive is a ZIP file of stored (method 0) members: ``archive/data.warc.gz``, one
gzip member a record, and ``indexes/index.cdxj``, a line a record with its offset
and length inside that member. The reader finds the end-of-central-directory
record, follows the ZIP64 locator where there is one, parses the central directory,
and then reads each record by its byte range alone; nothing is extracted. Archives are
opened on their store and read at offsets, so one of any size can be read: a first pass
reads directories and indexes, the index lines are dealt over tasks by place, and each
task reads its ranges, those that touch in one request. The writer always adds the
ZIP64 records.

Archives are written by Spark's own text writer, a record a file, so they land on
any store that Spark knows, under its commit protocol: a lost task leaves no half
archive. The writer ends every file with one line feed; it is declared as the
archive's one-byte ZIP comment.

Defined results
---------------
* null html: an empty payload; null url: an empty target URI; control characters in
  a url are percent-encoded.
* records with equal payloads of at least ``MIN_REVISIT`` bytes: those with the
  smallest page_id are responses (all rows that repeat it), others revisit it;
  a null page_id is never the smallest.
* an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
#: Index lines whose ranges touch are read together up to so many bytes.
REQUEST_BYTES = 1 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, sizes and markers.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_END64, _LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_URN = "urn:page:"

Read = Callable[[int, int], bytes]


# ---------------------------------------------------------------- ZIP
@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header_offset: int


def zip_archive(members: list[tuple[str, bytes]], *, comment_length: int = 0, zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64 writes the ZIP64 records even where sizes are small.

    The caller appends the comment of comment_length bytes.
    """
    out, directory = bytearray(), bytearray()
    for name, data in members:
        at, crc, label = len(out), zlib.crc32(data), name.encode()
        big = zip64 or max(len(data), at) >= _FULL32
        size = _FULL32 if big else len(data)
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data)) if big else b""
        out += _LOCAL.pack(LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(extra)) + label + extra + data
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at) if big else b""
        directory += _CENTRAL.pack(CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(extra), 0, 0, 0, 0, _FULL32 if big else at) + label + extra
    at, n = len(out), len(members)
    out += directory
    big = zip64 or at >= _FULL32 or n >= _FULL16
    if big:
        end = len(out)
        out += _END64.pack(END64, 44, 45, 45, 0, 0, n, n, len(directory), at) + _LOCATOR.pack(LOCATOR64, 0, end, 1)
    out += _END.pack(END, 0, 0, _FULL16 if big else n, _FULL16 if big else n, _FULL32 if big else len(directory), _FULL32 if big else at, comment_length)
    return bytes(out)


def read_directory(read: Read, total: int) -> list[Member]:
    """Members of the archive of `total` bytes behind read(offset, length)."""
    tail_from = max(0, total - _END.size - _FULL16)
    tail = read(tail_from, total - tail_from)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, size, offset, _ = _END.unpack_from(tail, at)
    locator_at = tail_from + at - _LOCATOR.size
    if locator_at >= 0 and (locator := read(locator_at, _LOCATOR.size))[:4] == LOCATOR64:
        end = _END64.unpack(read(_LOCATOR.unpack(locator)[2], _END64.size))
        count, size, offset = end[7], end[8], end[9]
    directory, members, at = read(offset, size), [], 0
    for _ in range(count):
        sig, _, _, _, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, header = _CENTRAL.unpack_from(directory, at)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        at += _CENTRAL.size
        name = directory[at : at + n_name].decode()
        extra = directory[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == 1:  # only the fields that are full in the header are there, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                size = next(values) if size == _FULL32 else size
                packed = next(values) if packed == _FULL32 else packed
                header = next(values) if header == _FULL32 else header
            extra = extra[4 + length :]
        members.append(Member(name, method, size, crc, header))
    return members


def data_offset(read: Read, member: Member) -> int:
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    header = _LOCAL.unpack(read(member.header_offset, _LOCAL.size))
    if header[0] != LOCAL:
        raise ValueError("broken local header")
    return member.header_offset + _LOCAL.size + header[9] + header[10]


# ---------------------------------------------------------------- WARC
@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _quoted(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def build_record(page: object, url: str, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One WARC record; a revisit has the HTTP headers, which tell the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'' if page is None else page}>", f"WARC-Target-URI: {_quoted(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


def pack(records: Iterator[tuple[object, str, bytes, str, object]], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of about archive_bytes from (page, url, payload, digest, refers_to)."""
    warc, index = bytearray(), []
    for page, url, payload, digest, refers_to in records:
        one = gzip.compress(build_record(page, url, payload, digest, refers_to), 1, mtime=0)
        index.append(json.dumps({"url": _quoted(url), "offset": len(warc), "length": len(one), "digest": f"sha256:{digest}"}))
        warc += one
        if len(warc) >= archive_bytes:
            yield zip_archive([(WARC_MEMBER, bytes(warc)), (INDEX_MEMBER, "\n".join(index).encode())], comment_length=1, zip64=True)
            warc, index = bytearray(), []
    if index:
        yield zip_archive([(WARC_MEMBER, bytes(warc)), (INDEX_MEMBER, "\n".join(index).encode())], comment_length=1, zip64=True)


def index_entries(read: Read, total: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the archive of every record, from its index."""
    members = {m.name: m for m in read_directory(read, total)}
    data = data_offset(read, members[WARC_MEMBER])
    index = members[INDEX_MEMBER]
    for line in read(data_offset(read, index), index.size).decode().split("\n"):
        entry = json.loads(line)
        yield data + entry["offset"], entry["length"]


def read_ranges(read: Read, entries: list[tuple[int, int]], request_bytes: int = REQUEST_BYTES) -> Iterator[Record]:
    """The records at ascending (offset, length), those that touch read in one request of about request_bytes at most."""
    at = 0
    while at < len(entries):
        to, size = at + 1, entries[at][1]
        while to < len(entries) and entries[to][0] == entries[at][0] + size and size + entries[to][1] <= request_bytes:
            size += entries[to][1]
            to += 1
        raw = read(entries[at][0], size)
        for offset, length in entries[at:to]:
            start = offset - entries[at][0]
            yield parse_record(gzip.decompress(raw[start : start + length]))
        at = to


def opened(uri: str) -> pa.NativeFile:
    """A file of any store that pyarrow opens, for reads at offsets."""
    store, name = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    return store.open_input_file(name)


# ---------------------------------------------------------------- Spark
def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    firsts = large.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = materialize(firsts.select(F.col("digest").alias("of"), "first"), "warc-firsts")
    known = rows.join(firsts, rows["digest"] == firsts["of"], "left")
    refers_to = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    known = known.select("page", "url", "payload", "digest", refers_to.alias("refers_to"))
    archive_bytes = ARCHIVE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (tuple(v.as_py() for v in row) for b in batches for row in zip(*b.columns, strict=True))
        for archive in pack(records, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])

    archives = known.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record; the digest of a response is taken anew."""
    schema = f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}, url string"
    number = id_type != "string"

    def page(urn: str | None) -> object:
        name = (urn or "").strip("<>").removeprefix(_URN)
        return None if not name else int(name) if number else name

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(uri) as file:
                    entries = list(index_entries(lambda at, n, file=file: file.read_at(n, at), total))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(entries)), pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int64())], ["path", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pa.int64() if number else pa.string()
        kinds = pa.schema([("page_id", key), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", key), ("url", pa.string())])
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_file.setdefault(uri, []).append((offset, length))
            rows = []
            for uri, entries in by_file.items():
                with opened(uri) as file:
                    for r in read_ranges(lambda at, n, file=file: file.read_at(n, at), entries):
                        digest, kind = r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), r.headers["WARC-Type"]
                        size = int(r.http["Content-Length"])
                        if kind == "response" and (len(r.payload) != size or hashlib.sha256(r.payload).hexdigest() != digest):
                            raise ValueError(f"{r.headers['WARC-Record-ID']}: the payload does not match its digest")
                        rows.append({"page_id": page(r.headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(r.headers.get("WARC-Refers-To")), "url": r.headers["WARC-Target-URI"]})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    # of a binary file only path and length are asked for, so its content is not read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    tasks = max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // ARCHIVE_BYTES))
    entries = files.repartition(tasks).mapInArrow(listed, "path string, offset bigint, length bigint")
    entries = materialize(entries, "warc-index").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return entries.mapInArrow(records, schema)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages to archives in the shared folder, then read the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    kind = dict(pages.dtypes)[columns.get("id_col", "page_id")]
    return read_archives(pages.sparkSession, path, "string" if kind == "string" else "bigint")
