"""Web archives in ZIP packages: written by tasks, read back by ranges without extraction.

A package is a ZIP64 file of stored members: archive/data.warc.gz (one gzip member a record), indexes/index.cdx (a
line a record with its place) and datapackage.json. The reader takes the tail of a package, parses the end record, the
ZIP64 locator and end record and the central directory, finds the stored members' data behind their local headers,
reads the index, and then reads only the byte ranges that hold records.

Files are reached through pyarrow's file systems, so that the shared folder can be on any store it knows. A task writes
packages of about PACKAGE_BYTES under names of its own and lists them; only lists of tasks that succeeded are read.
Ranges of about BLOCK_BYTES are the unit of reading, so a large package is read by many tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, scratch_path

PACKAGE_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_URN = "urn:page:"


def _b32(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; without a payload it is a revisit, whose HTTP header still tells the full size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {_b32(digest)}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record, with its payload's digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    own = fields["WARC-Record-ID"][1:-1].removeprefix(_URN)
    other = fields.get("WARC-Refers-To")
    return {"page_id": None if own == "none" else int(own), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other[1:-1].removeprefix(_URN)) if other else None}


def package(records: list[tuple[bytes, str, str]]) -> bytes:
    """A ZIP64 package of (record, digest, url)."""
    data, index, at = [], [], 0
    for raw, digest, url in records:
        squeezed = zlib.compressobj(1, zlib.DEFLATED, 31)
        part = squeezed.compress(raw) + squeezed.flush()
        index.append(f"{quote(url, safe=':/?#@!$&()*+,;=%~-._')} 19700101000000 {json.dumps({'digest': digest, 'offset': at, 'length': len(part)})}")
        data.append(part)
        at += len(part)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, b"".join(data)), (INDEX, "\n".join(index).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA, "bytes": at}]}).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(content)
    return out.getvalue()


def directory(read_at, size: int) -> dict[str, tuple[int, int]]:  # noqa: ANN001
    """(data offset, length) of each stored member. read_at(offset, length) gives a range of the file."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", locator[8:16])[0]
        end64 = read_at(at, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, offset = struct.unpack("<QQQ", end64[32:56])
    elif count == 0xFFFF or offset == 0xFFFFFFFF:
        raise ValueError("ZIP64 sizes without a locator")
    central, at, out = read_at(offset, length), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, plain, n, m, k, start = struct.unpack("<10xH8xIIHHH8xI", central[at : at + 46])
        name = central[at + 46 : at + 46 + n].decode()
        extra = central[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            tag, width = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                start = next(wide) if start == 0xFFFFFFFF else start
            extra = extra[4 + width :]
        at += 46 + n + m + k
        if method == 0:
            local = read_at(start, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            out[name] = (start + 30 + sum(struct.unpack("<HH", local[26:30])), plain)
    return out


def decide(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the revisits: equal payloads of at least `least` bytes but the largest page_id."""
    keys = pages.select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("payload_digest")).where(F.col("size") >= least)
    last = keys.groupBy("payload_digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = keys.join(last, ["payload_digest", "size"])
    return found.where(~F.coalesce(F.col("page_id") == F.col("refers_to"), F.col("refers_to").isNull())).select("page_id", "payload_digest", "refers_to").distinct()


def write_packages(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into packages of `folder`; returns (path, bytes, records)."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "packages")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    marks = decide(rows, least).select(F.col("page_id").alias("m_id"), F.col("payload_digest").alias("m_digest"), "refers_to")
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(marks, rows["page_id"].eqNullSafe(marks["m_id"]) & (F.col("digest") == F.col("m_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close(held: list) -> pa.RecordBatch:
            path = f"{root}/part-{uuid.uuid4().hex}.wacz"
            content = package(held)
            with store.open_output_stream(path) as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [len(content)], "records": [len(held)]})

        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append((warc_record(page_id, url, payload if refers_to is None else None, len(payload), digest, refers_to), _b32(digest), url or ""))
                size += len(held[-1][0])
                if size >= PACKAGE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return cut(rows.mapInArrow(run, "path string, bytes long, records long"), "package-list")


def read_packages(packages: DataFrame, folder_uri: str, with_payload: bool = True) -> DataFrame:
    """Records of packages (path): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    folder_uri names the store that the paths are in.
    """
    ship(packages.sparkSession)

    def opened(path: str):  # noqa: ANN202
        store, _ = pafs.FileSystem.from_uri(folder_uri)
        return store.open_input_file(path)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    read_at = lambda at, n, f=f: f.read_at(n, at)
                    members = directory(read_at, f.size())
                    index = read_at(*members[INDEX]).decode()
                base, lengths, start, at = members[DATA][0], [], 0, 0
                out: dict[str, list] = {"path": [], "start": [], "lengths": []}
                places = sorted((x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in index.split("\n") if line))
                for offset, n in [*places, (None, 0)]:
                    if lengths and (offset is None or offset != at or at - start >= BLOCK_BYTES):
                        for k, v in zip(out, (path, base + start, lengths), strict=True):
                            out[k].append(v)
                        lengths = []
                    if offset is not None:
                        start = start if lengths else offset
                        lengths = [*lengths, n] if len(lengths) < 2 else (lengths.append(n) or lengths)
                        at = offset + n
                yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    fields = [("page_id", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if with_payload else []), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                with opened(path) as f:
                    block = f.read_at(sum(lengths), start)
                at, rows = 0, []
                for n in lengths:
                    rows.append(parse_record(gzip.decompress(block[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    blocks = packages.select("path").mapInArrow(ranges, "path string, start long, lengths array<long>").repartition(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return blocks.mapInArrow(records, ", ".join(f"{n} {kinds[k]}" for n, k in fields))


def archive_and_read(pages: DataFrame, least: int = 1000, with_payload: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) into packages and reads all records back.

    Of equal payloads of at least `least` bytes the row with the largest page_id is the response and the others
    revisit it; shorter ones are all responses. Null html is the empty payload. A row of null page_id revisits the
    largest id with its payload, or is a response where all ids are null; rows that repeat both id and payload have
    the same type. Null urls read back as empty. An empty table writes no package and gives an empty result.
    """
    folder = scratch_path(pages.sparkSession, "packages")
    return read_packages(write_packages(pages, least, folder), folder, with_payload)
