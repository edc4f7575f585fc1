"""Legacy archive converter: ARC files to WARC files, and a reader for what it writes.

An ARC file begins with a version block whose first line is the file's own record header, and whose
second line names the version; version 1 headers have five fields, version 2 headers ten. Each record
is a header line and exactly the declared number of bytes. The converter parses the header by the
file's version and the body by its declared length, and synthesises what WARC wants: a record id
(a name-based UUID of the archive's digest and the record's place in it, so that a second run over the
same archives gives the same), an ISO timestamp from the fourteen digits, a record type from the URL
scheme, and SHA-1 digests of block and payload in base 32.

Records of equal payload (compared by SHA-256 and length) from least_bytes on become one response,
that with the largest key, and revisits that refer to it by its record id, URI and date. A private
header, WARC-Refers-To-Key, repeats its key, so that a reader needs no join. Archives are parsed once, and
payloads are grouped before the files are written, so only the files' own tasks hold payloads, one file's
worth at a time. Files of about
FILE_BYTES are written under a temporary name and then moved, and a task that runs again writes the
same names, so lost executors leave no half files. Every record is a gzip member of its own.

Edge cases: a null payload counts as empty. A null URL becomes unknown:; blanks and control characters in one
are percent-encoded. A null key is smaller than any other and comes back null. Repeated rows with equal
key and payload are all responses where the key is the largest. Declared lengths beyond the end of a file
raise an error, as do header lines with a wrong number of fields. An empty table gives no files and an
empty result. Columns that are not named in a call are not looked at, whatever their names. A single archive file
is read whole by one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, shared_dir, written
from voxlake.storage import Files

#: Bytes of records, before compression, in one archive file.
FILE_BYTES = 8 << 20
#: What the second and third lines of a version block say.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
KEY_HEADER = "X-Record-Key"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def clean_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|") if url else "unknown:"


def http_response(payload: bytes, key: int | None) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", f"{KEY_HEADER}: {'' if key is None else key}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload


def write_arc(records: list[ArcRecord], version: int, name: str = "legacy.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of the given version."""
    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    out = []
    for r in [ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", block), *records]:
        middle = f" 200 - - {sum(map(len, out))} {name}" if version == 2 else ""
        out.append(f"{r.url} {r.ip} {r.date} {r.mime}{middle} {len(r.body)}\n".encode() + r.body + b"\n")
    return b"".join(out)


def unzipped(raw: bytes) -> bytes:
    """The members of a gzip file, one after the other; other bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    parts = []
    while raw:
        d = zlib.decompressobj(31)
        parts.append(d.decompress(raw) + d.flush())
        raw = d.unused_data.lstrip(b"\0")
    return b"".join(parts)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, zipped or plain, version block first; its version decides how headers are parsed."""
    raw, at, fields = unzipped(raw), 0, 0
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.index(b"\n", at)
        parts = raw[at:end].decode("utf-8", "replace").split(" ")
        size = int(parts[-1])
        body = raw[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(body)} are left")
        if not fields:
            version = int(body.split(b" ", 1)[0])
            fields = len(ARC_FIELDS[version].split(" "))
        if len(parts) != fields:
            raise ValueError(f"record header at {at} has {len(parts)} fields, not {fields}")
        yield ArcRecord(*parts[:4], body)
        at = end + 1 + size


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload; a body that is no HTTP message is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def key_of(head: bytes) -> int | None:
    m = re.search(rb"(?im)^" + KEY_HEADER.encode() + rb": *(-?\d+)\r?$", head)
    return int(m[1]) if m else None


def iso_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, number: int) -> str:
    """A name-based UUID: of the archive's own digest and the record's place in it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {number}')}>"


class Original(NamedTuple):
    """The response that a revisit refers to."""

    key: int | None
    id: str
    url: str
    date: str


def warc_record(r: ArcRecord, identity: str, original: Original | None = None) -> bytes:
    """The WARC record that an ARC record becomes; with an original, a revisit of it."""
    head, payload = split_http(r.body)
    block = head if original else r.body
    scheme = r.url.split(":", 1)[0].lower()
    kind = "revisit" if original else "warcinfo" if scheme == "filedesc" else "response" if head else "resource"
    mime = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if head else r.mime
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {identity}",
        f"WARC-Date: {iso_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {mime}",
        f"Content-Length: {len(block)}",
    ]
    if original:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {original.id}",
            f"WARC-Refers-To-Target-URI: {original.url}",
            f"WARC-Refers-To-Date: {iso_date(original.date)}",
            f"WARC-Refers-To-Key: {original.key}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, gzip members or plain."""
    raw, at = unzipped(raw), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"record at {at} is damaged")
        yield headers, block
        at = end + 4 + size + 4


_ARC = pa.schema([("content", pa.binary())])
_RECORDS = pa.schema([("key", pa.int64()), ("id", pa.string()), ("sha256", pa.binary()), ("size", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("body", pa.binary())])
_RECORDS_DDL = "key long, id string, sha256 binary, size long, url string, ip string, date string, mime string, body binary"
_READ = pa.schema([("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())])


def pages_to_arc(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as legacy ARC files (content), versions 1 and 2 in turn."""
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, files = [], 0, 0
        for batch in batches:
            for key, url, payload in zip(*batch.columns, strict=True):
                raw = (payload.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(ArcRecord(clean_url(url.as_py()), "0.0.0.0", date, "text/html", http_response(raw, key.as_py())))
                size += len(raw)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([write_arc(held, 1 + files % 2)], pa.binary())], schema=_ARC)
                    held, size, files = [], 0, files + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_arc(held, 1 + files % 2)], pa.binary())], schema=_ARC)

    return rows.mapInArrow(pack, "content binary")


def load_archives(spark: SparkSession, path: str, pattern: str = "*.arc*") -> DataFrame:
    """ARC files below a folder on any file system of Spark, zipped or plain, as rows (content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("content")


def parse_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC files (content), without their version blocks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for content in batch.column(0):
                    raw = content.as_py()
                    archive = hashlib.sha256(raw).hexdigest()
                    for number, r in enumerate(read_arc(raw)):
                        if not r.url.startswith("filedesc:"):
                            head, payload = split_http(r.body)
                            yield key_of(head), record_id(archive, number), hashlib.sha256(payload).digest(), len(payload), *r

        yield from by_bytes(found(), _RECORDS, lambda r: 300 + r[3])

    return archives.select("content").mapInArrow(parse, _RECORDS_DDL)


def convert_archives(spark: SparkSession, archives: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> int:
    """Writes the records of ARC files (content) as WARC files into folder; returns how many records."""
    records = written(spark, parse_arc(archives), "records", "zstd")
    originals = records.where(F.col("size") >= least_bytes).groupBy("sha256", "size").agg(F.max(F.struct("key", "id", "url", "date")).alias("o"))
    revisit = F.col("o").isNotNull() & ~F.col("key").eqNullSafe(F.col("o.key"))
    typed = records.join(originals, ["sha256", "size"], "left").select(
        "key", "id", "url", "ip", "date", "mime", "body", F.when(revisit, F.col("o.key")).alias("o_key"), F.when(revisit, F.col("o.id")).alias("o_id"), F.when(revisit, F.col("o.url")).alias("o_url"), F.when(revisit, F.col("o.date")).alias("o_date")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, number, total = TaskContext.get(), 0, 0
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, size, number
            name = f"{root}/part-{context.partitionId():06d}-{number:05d}.warc.gz"
            draft = f"{root}/_draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(b"".join(held))
            store.move(draft, name)
            held, size, number = [], 0, number + 1

        for batch in batches:
            for _, identity, url, ip, date, mime, body, o_key, o_id, o_url, o_date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = ArcRecord(url, ip, date, mime, body)
                if not held:
                    info = ArcRecord("filedesc://converted", "0.0.0.0", r.date, "text/plain", b"format: WARC File Format 1.1\r\n")
                    held.append(gzip.compress(warc_record(info, record_id(f"info {identity}", 0)), 6, mtime=0))
                original = Original(o_key, o_id, o_url, o_date) if o_id else None
                held.append(gzip.compress(warc_record(r, identity, original), 6, mtime=0))
                size, total = size + len(r.body), total + 1
                if size >= file_bytes:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    Files(spark, folder).make()
    # in a fixed order, so that a task that runs again writes the same files
    ordered = typed.sortWithinPartitions("o_key", "key", "id")
    return ordered.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record but the warcinfo ones: key, payload_bytes, payload_digest, record_type, refers_to, url, date."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for content in batch.column(0):
                    for headers, block in read_warc(content.as_py()):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            size = int(re.search(rb"(?im)^Content-Length: *(\d+)", head)[1])
                        elif digest != sha1_base32(payload):
                            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                        else:
                            size = len(payload)
                        yield key_of(head), size, digest, kind, int(headers["warc-refers-to-key"]) if kind == "revisit" else None, headers["warc-target-uri"], headers["warc-date"]

        yield from by_bytes(found(), _READ, lambda r: 120)

    return files.mapInArrow(read, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one, as a URI."""
    base = shared_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/voxlake/warc-{uuid.uuid4().hex}"
