"""WARC archives: write, normalise monolithic gzip, index, read.

Each task turns its rows into archives of about ``ARCHIVE_BYTES`` of payload, written the way
crawlers that know nothing of record access do: one gzip stream for the whole file. The
normaliser inflates such a stream once, front to back, and rewrites every record as a gzip
member of its own, noting offset and length: the sidecar index, with which one record is read
by inflating one member. Archives that already have a member for each record pass through the
same way.

Payloads of ``REVISIT_BYTES`` or more that are equal (SHA-1 and length) are stored once: the record
with the largest page id is the response, the others are revisits that refer to it. Only
digests are grouped; payloads are not shuffled unless the table of repeated digests outgrows
Spark's broadcast threshold, and then by a sort-merge join that splits a frequent digest.

Archives are rows (archive, content, index) of a Parquet table in the cluster's shared
folder, whose commit protocol makes a rerun task harmless. ``export`` writes them as .warc.gz
files with .idx sidecars, ``load`` reads any .warc.gz files.

Defined cases: null html is an empty payload, a null url an empty target. A row without page id
is a revisit if another row with an id holds its payload, else a response. Rows of equal
payload and equal, largest id are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bytesops as B
from lexmill.llm.scratch import Scratch

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 1000
LEVEL = 4
CHUNK = 1 << 16
DATE = "2025-01-01T00:00:00Z"
INDEX = "array<struct<offset:long,length:long,record_id:string,type:string>>"
ARCHIVES = f"archive string, content binary, index {INDEX}"
_index_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))


def record(kind: str, ident: str, target: str | None, block: bytes, more: dict[str, str]) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target or "")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": DATE, **({"WARC-Target-URI": target} if target else {}), **more, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, where: str) -> bytes:
    ident = f"urn:page:{page_id}" if page_id is not None else f"urn:page:none:{where}"
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    more = {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", ident, url, http.encode() + payload, more)
    more |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", ident, url, http.encode(), more)


def _write(size: int, level: int):
    @B.lean
    def run(batches):
        task, k, n = TaskContext.get().partitionId(), 0, 0
        name, z, parts, held = "", None, [], 0

        def done():
            return pa.RecordBatch.from_pydict({"archive": pa.array([name]), "content": pa.array([b"".join([*parts, z.flush()])], pa.binary())})

        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if z is None:
                    name, z, parts, held = f"part-{task:06d}-{k:05d}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                    k += 1
                    parts.append(z.compress(record("warcinfo", f"urn:archive:{name}", None, b"software: lexmill\r\nformat: WARC File Format 1.1\r\n", {"WARC-Filename": name, "Content-Type": "application/warc-fields"})))
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                parts.append(z.compress(page_record(page_id.as_py(), url.as_py(), payload, refers.as_py(), f"{task}-{n}")))
                held += len(payload)
                n += 1
                if held >= size:
                    yield done()
                    z = None
        if z is not None:
            yield done()

    return run


def inflate(content: bytes | memoryview) -> Iterator[bytes]:
    """The bytes of all gzip members, one after the other, in chunks."""
    content, at = memoryview(content), 0
    while at < len(content):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(content):
                raise ValueError("the gzip stream ends early")
            part = z.decompress(content[at : at + CHUNK])
            at += min(CHUNK, len(content) - at)
            if part:
                yield part
        at -= len(z.unused_data)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields with lower-case names, block, the record's bytes) of a stream of WARC records."""
    buf, at = bytearray(), 0

    def more() -> bool:
        nonlocal buf, at
        part = next(stream, None)
        if part is None:
            return False
        if at:
            del buf[:at]
            at = 0
        buf += part
        return True

    while True:
        while (head := buf.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buf[at:]).strip():
                    raise ValueError("the archive ends inside a record header")
                return
        version, *lines = bytes(buf[at:head]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        size = head - at + 4 + length + 4
        while len(buf) - at < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        whole = bytes(buf[at : at + size])
        at += size
        yield fields, whole[-length - 4 : -4] if length else b"", whole


def normalise(content: bytes, level: int = LEVEL) -> tuple[bytes, list[dict]]:
    """The archive with each record as a gzip member of its own, and its index."""
    out, index, at = [], [], 0
    for fields, _, whole in records(inflate(content)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        out.append(member)
        index.append({"offset": at, "length": len(member), "record_id": fields["warc-record-id"].strip("<>"), "type": fields["warc-type"]})
        at += len(member)
    return b"".join(out), index


def _normalise(level: int):
    @B.lean
    def run(batches):
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                if content.is_valid:
                    data, index = normalise(memoryview(content.as_buffer()), level)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([index], _index_type)], names=["archive", "content", "index"])

    return run


@B.lean
def _read(batches):
    for b in batches:
        for name, content, index in zip(b.column("archive").to_pylist(), b.column("content"), b.column("index"), strict=True):
            data = memoryview(content.as_buffer())
            for entries in _parts(index.as_py(), 256):
                rows = []
                for x in entries:
                    if x["type"] not in ("response", "revisit"):
                        continue
                    member = data[x["offset"] : x["offset"] + x["length"]]
                    fields, block, _ = next(records(inflate(member)))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sha = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                    refers = fields.get("warc-refers-to", "").strip("<>")
                    if x["type"] == "response":
                        length, sha = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((_page(x["record_id"]), fields.get("warc-target-uri"), payload, length, sha, x["type"], _page(refers), name))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])


def _parts(x: list, n: int):
    return (x[k : k + n] for k in range(0, len(x), n))


def _page(ident: str) -> int | None:
    tail = ident.removeprefix("urn:page:")
    return int(tail) if re.fullmatch(r"-?[0-9]+", tail) else None


def plan(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's page id for revisits, else null."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    repeated = base.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1 AND holder IS NOT NULL").drop("copies")
    repeated = scratch.table(repeated, "repeated")
    out = base.join(repeated, ["digest", "size"], "left")
    return out.select("page_id", "url", "html", F.expr("CASE WHEN page_id IS NULL OR page_id < holder THEN holder END").alias("refers_to"))


def monolithic(planned: DataFrame, size: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """(archive, content): archives that are one gzip stream each."""
    return planned.mapInArrow(_write(size, level), "archive string, content binary")


def normalised(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """(archive, content, index) of archives (archive, content), with a gzip member for each record."""
    return archives.mapInArrow(_normalise(level), ARCHIVES)


def read(archives: DataFrame) -> DataFrame:
    """One row for each response or revisit record, read through the index: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, archive."""
    return archives.mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of .warc.gz files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write .warc.gz files and .idx sidecars to a folder that all executors mount; returns the file names.

    Files appear under their names only when whole, so a rerun task replaces equal content.
    """

    @B.lean
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, content, index in zip(b.column("archive").to_pylist(), b.column("content"), b.column("index").to_pylist(), strict=True):
                text = "".join(f"{x['record_id']} {x['type']} {x['offset']} {x['length']}\n" for x in index)
                for file, data in ((name, content.as_buffer()), (f"{name}.idx", text.encode())):
                    part = f"{folder}/.{file}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, f"{folder}/{file}")
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name])})

    return sorted(r.archive for r in archives.mapInArrow(run, "archive string").collect())


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.table(normalised(monolithic(plan(pages, scratch))), "archives")
    found = read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return scratch.result(found)


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < holder THEN holder END AS refers_to
FROM g
"""
