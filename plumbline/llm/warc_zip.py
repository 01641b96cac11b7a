"""WARC records in ZIP packages: writing them, and reading them by byte ranges without extraction.

A package is a ZIP file of stored members: archive/data.warc.gz (each record a gzip member of its own)
and indexes/index.cdxj (a line per record with its offset and length in the archive).  The reader finds
the end-of-central-directory record, follows the ZIP64 one where sizes or counts overflow, reads the
central directory, locates the members' data behind their local headers, reads the index member, and
then reads each record by its range alone.  Index lines are rows of a DataFrame, so the records of one
large package are read by many tasks.

Each writing task gives its packages names of their own and reports them in the table of packages,
which goes to the shared folder; files of lost attempts are in no table and are never read.

Defined results: a null payload is empty; payloads under REVISIT_BYTES are always responses; rows that
repeat the page_id of a response with its payload are responses too; a null page_id keeps its row but
is never the response that others refer to; an empty table gives no packages and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, keyed_join, prepare, staged, staged_path, table

REVISIT_BYTES = 1000
#: A package is closed once its archive has so many bytes.
PACKAGE_BYTES = 64 << 20
#: Bytes of an archive whose records are read by one group of rows, and of a reading task, about.
READ_BYTES, TASK_BYTES = 4 << 20, 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed by itself."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n") + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one compressed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


class PackageWriter:
    """Writes records into packages of bounded size under one folder."""

    def __init__(self, folder: str, most: int = PACKAGE_BYTES):
        self.folder, self.most, self.done, self._zip = folder, most, [], None

    def _open(self) -> None:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.wacz"
        self._sink = system.open_output_stream(f"{path}/{name}")
        self._name, self._index, self._at = f"{self.folder}/{name}", [], 0
        self._zip = zipfile.ZipFile(self._sink, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, url: str | None, packed: bytes) -> None:
        if self._zip is None:
            self._open()
        self._member.write(packed)
        self._index.append(f"{' '.join((url or '-').split()) or '-'} 20240101000000 " + json.dumps({"filename": "data.warc.gz", "offset": self._at, "length": len(packed)}))
        self._at += len(packed)
        if self._at >= self.most:
            self.close()

    def close(self) -> None:
        if self._zip is None:
            return
        self._member.close()
        self._zip.writestr(INDEX, "".join(line + "\n" for line in self._index))
        self._zip.close()
        self._sink.close()
        self.done.append((self._name, len(self._index), self._at))
        self._zip = None


def _range(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    out = file.read(size)
    if len(out) < size:
        raise ValueError(f"file ends before byte {at + size}")
    return out


def members(file: BinaryIO, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: name -> where its data begins, and bytes.  Only the directory and
    the local headers are read."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        locator = _range(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    directory = _range(file, at, length)
    out, pos = {}, 0
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<H8xIIHHH", directory, pos + 10)
        begin = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46 : pos + 46 + n_name].decode()
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        pos += 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                begin = next(wide) if begin == 0xFFFFFFFF else begin
            extra = extra[4 + n :]
        if method == 0:
            local = _range(file, begin, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("no local header where the directory points")
            own_name, own_extra = struct.unpack_from("<HH", local, 26)
            out[name] = begin + 30 + own_name + own_extra, plain
    return out


def index_entries(path: str) -> Iterator[tuple[int, int]]:
    """Where each record of a package lies in the file, and its bytes."""
    system, at = file_system(path)
    with system.open_input_file(at) as file:
        stored = members(file, file.size())
        archives = {name.rpartition("/")[2]: place for name, place in stored.items() if name.startswith("archive/")}
        for name, (begin, size) in stored.items():
            if name.startswith("indexes/"):
                for line in _range(file, begin, size).splitlines():
                    entry = json.loads(line[line.index(b" {") :])
                    yield archives[entry["filename"]][0] + int(entry["offset"]), int(entry["length"])


PACKAGES = "package string, records long, bytes long"


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); returns the table of packages."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or staged_path(spark, "packages")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # written first, so that its size is known: few digests occur twice
    shared = staged(rows.filter(large).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1 and owner is not null"), "owners")
    rows = keyed_join(rows, F.col("digest"), shared, ["owner"]).withColumn("refers_to", F.when(large & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")))

    def write(batches):
        writer = PackageWriter(folder)
        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                writer.add(url, record(page_id, url, text.encode(), digest, refers_to))
        writer.close()
        names, records, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["package", "records", "bytes"])

    return staged(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, PACKAGES), "package-table")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record of the packages (package: their URIs): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (null for revisits)."""
    spark = packages.sparkSession
    prepare(spark)

    def locate(batches):
        for batch in batches:
            for path in batch["package"].to_pylist():
                entries = list(index_entries(path))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries), pa.string()), pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int64())], names=["package", "at", "length"])

    def read(batches):
        for batch in batches:
            rows: list[tuple] = []
            opened, file = None, None
            for path, at, length in zip(*(batch[c].to_pylist() for c in ("package", "at", "length")), strict=True):
                if path != opened:
                    system, local = file_system(path)
                    opened, file = path, system.open_input_file(local)
                rows.append(_row(*parse_record(_range(file, at, length))))
                if len(rows) == 500:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    cores = spark.sparkContext.defaultParallelism
    files = packages.select("package").repartition(max(1, min(packages.count(), 4 * cores)))
    entries = staged(files.mapInArrow(locate, "package string, at long, length long"), "entries")
    # numbers of tasks follow the bytes to be read, not the few bytes of index rows that are shuffled
    size = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(cores, size // READ_BYTES), -(-size // TASK_BYTES))
    spread = entries.repartition(tasks, "package", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("package", "at")
    return spread.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _id(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """A response's bytes and digest are those of the payload just read, and have to be the stated ones."""
    kind = headers["warc-type"]
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, payload = int(headers["warc-payload-length"]), None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"record {headers['warc-record-id']} does not hold its payload")
    return _id(headers["warc-record-id"]), headers["warc-target-uri"], kind, _id(headers.get("warc-refers-to")), size, digest, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as records and read the packages back."""
    records = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
owned AS (SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS owner FROM rows)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN strlen(payload) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM owned
"""
